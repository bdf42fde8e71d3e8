"""Uniform quantization of residuals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bounds import num

RADIUS = 32768


def toward_zero(delta: Column, e) -> Column:
    """Code of a residual; a residual in the middle between two codes takes the one nearer to zero."""
    e = num(e)
    return F.when(delta >= 0, F.ceil((delta - e) / (2 * e))).otherwise(F.floor((delta + e) / (2 * e))).cast("long")


def away_from_zero(delta: Column, e) -> Column:
    """Code of a residual; a residual in the middle between two codes takes the one farther from zero."""
    e = num(e)
    half = F.shiftright(F.floor(F.abs(delta) / e).cast("long") + 1, 1)
    return F.when(delta < 0, -half).otherwise(half)


def shifted_code(x: Column, pred: Column, e, radius: int = RADIUS) -> Column:
    """Non-negative code ``radius + away_from_zero``, 0 where the code is out of range or its value misses the bound."""
    e, delta = num(e), x - pred
    code = away_from_zero(delta, e)
    fits = (F.floor(F.abs(delta) / e) + 1 < 2 * radius) & (F.abs(pred + 2 * e * code - x) <= e)
    return F.when(fits, code + radius).otherwise(F.lit(0)).cast("long")


def shifted_value(code: Column, pred: Column, raw: Column, e, radius: int = RADIUS) -> Column:
    """Value of a shifted code; code 0 stands for the raw value beside it."""
    return F.when(code == 0, raw).otherwise(pred + 2 * num(e) * (code - radius))


def dequantize(pred: Column, code: Column, e) -> Column:
    """Value of a code, held in [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pred + 2 * num(e) * code))


def coefficients(w: Column, base: Column, e) -> Column:
    """Array of coefficients as array of struct(code, value), quantized as differences from ``base``."""
    code = lambda x, b: toward_zero(x - b, e)
    return F.zip_with(w, base, lambda x, b: F.struct(code(x, b).alias("code"), (b + 2 * num(e) * code(x, b)).alias("value")))
