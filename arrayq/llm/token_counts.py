"""Delta-maintained token counts by source, language and tokenizer version.

A batch of deltas holds signed rows: +1 for an inserted document, -1 for a deleted one, and for a revised count
the old row with -1 and the new one with +1.  Committing a batch writes its own sums to a new attempt folder of the batch
number, and the latest complete attempt counts: a replay or a retry after a failure changes nothing, and one that breaks off
leaves the attempt before it in force.  Totals are the sums over all batches, and compact() folds them into one base.  One
process commits and compacts at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .packing import encoder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
#: Tokenizer versions: a regular expression that matches one token with what surrounds it, its first character as group 1, or text
#: without tokens.  A token leaves one character of the text, so that no list of tokens is built.
TOKENIZERS = {
    "words-1": r"[\x20\x09-\x0D]*([^\x20\x09-\x0D])[^\x20\x09-\x0D]*[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",
    "alnum-1": r"\P{Alnum}*(\p{Alnum})\p{Alnum}*\P{Alnum}*|\P{Alnum}+",  # ASCII only
}


def deltas(docs: DataFrame, tokenizer: str, sign: int | Column = 1) -> DataFrame:
    """(source, lang, tokenizer, sign, tokens) for each row of docs(text, source, lang, ...); null texts have no tokens.

    tokenizer: one of TOKENIZERS, or else the name of a public byte-level BPE vocabulary, whose ids are counted in Arrow batches.
    """
    keys = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), (F.lit(sign) if isinstance(sign, int) else sign).cast("long").alias("sign")]
    if tokenizer in TOKENIZERS:
        return docs.select(*keys, F.coalesce(F.length(F.regexp_replace("text", TOKENIZERS[tokenizer], "$1")), F.lit(0)).cast("long").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in W.pieces(batches, "text"):
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEYS, "sign")), pa.array(n, pa.int64())], [*KEYS, "sign", "tokens"])

    return docs.select(*keys, "text").mapInArrow(run, "source string, lang string, tokenizer string, sign long, tokens long")


def revisions(old: DataFrame, new: DataFrame, tokenizer: str) -> DataFrame:
    """The deltas of documents old(text, source, lang, ...) that have become new(...)."""
    return deltas(old, tokenizer, -1).unionByName(deltas(new, tokenizer))


class Rollup:
    """Totals in a shared folder: batch-N/attempt-K-.., base-K-.. and, with the batch numbers that are in it, folded-K-.. ."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch: int, rows: DataFrame) -> None:
        """Add batch number ``batch``, in place of an earlier attempt; one that is folded already is left as it is.

        Null keys are keys of their own; rows with a null sign or count add nothing to the sums of it.
        """
        base, folded = self._base()
        if int(batch) in folded:
            return
        sums = rows.groupBy(*KEYS).agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).alias("tokens"))
        sums.write.parquet(self._next(f"{self.path}/batch-{int(batch)}", "attempt-"))

    def compact(self) -> None:
        """Fold all committed batches into one base; what it replaces is deleted once it is complete."""
        base, folded = self._base()
        batches = self._batches(folded)
        if not batches:
            return
        new = self._next(self.path, "base-")
        numbers = self.spark.createDataFrame([(n,) for n in sorted(folded | batches.keys())], "batch long")
        numbers.write.parquet(new.replace("/base-", "/folded-"))
        self._sums([*batches.values(), *([base] if base else [])]).write.parquet(new)
        for old in [*(f"{self.path}/batch-{n}" for n in batches), *([base, base.replace("/base-", "/folded-")] if base else [])]:
            at = self._at(old)
            self._files(at).delete(at, True)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches; groups that deletes emptied are gone.

        Of several attempts at one batch the latest complete one counts; without batches there are no rows.
        """
        base, folded = self._base()
        return self._sums([*self._batches(folded).values(), *([base] if base else [])])

    def _sums(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, at):
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str, kind: str) -> list[str]:
        at = self._at(path)
        names = [s.getPath().getName() for s in self._files(at).listStatus(at)] if self._files(at).exists(at) else []
        return sorted(n for n in names if n.startswith(kind))

    def _next(self, path: str, kind: str) -> str:
        """A new folder that comes after all others of its kind, complete or not."""
        last = max([int(n.removeprefix(kind).split("-")[0]) for n in self._listed(path, kind)], default=0)
        return f"{path}/{kind}{last + 1:012d}-{uuid.uuid4().hex}"

    def _latest(self, path: str, kind: str) -> str | None:
        for n in reversed(self._listed(path, kind)):
            done = self._at(f"{path}/{n}/_SUCCESS")
            if self._files(done).exists(done):  # others broke off
                return f"{path}/{n}"
        return None

    def _base(self) -> tuple[str | None, set[int]]:
        base = self._latest(self.path, "base-")
        return base, {r.batch for r in self.spark.read.schema("batch long").parquet(base.replace("/base-", "/folded-")).collect()} if base else set()

    def _batches(self, folded: set[int]) -> dict[int, str]:
        """The attempt in force of each batch that is not folded."""
        numbers = {int(n.removeprefix("batch-")) for n in self._listed(self.path, "batch-")} - folded
        return {n: p for n in sorted(numbers) if (p := self._latest(f"{self.path}/batch-{n}", "attempt-"))}
