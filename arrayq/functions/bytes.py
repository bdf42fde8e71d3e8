"""Integers as big-endian bytes and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bytes(x: Column, size: int) -> Column:
    """The ``size`` (1 to 8) lowest bytes of an integer in two's complement, the highest first."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * size)))


def from_bytes(b: Column, size: int) -> Column:
    """The signed integer of to_bytes()."""
    v = F.conv(F.hex(b), 16, -10).cast("long")
    return v if size == 8 else F.when(v >= 1 << (8 * size - 1), v - (1 << (8 * size))).otherwise(v)
