"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ASCII bytes that are not part of a word become spaces; A-Z become a-z; other bytes stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage; ``sql`` gives the same rows in DuckDB."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """16-byte digest of a text; rows are joined by it where ids may be null or repeat."""
    return F.unhex(F.md5(text_of(column).cast("binary")))


def held_out(column: str = "doc_id") -> Column:
    """True on the fifth of ids from which no label is learned."""
    return F.coalesce(
        F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False)
    )


def stored(df: DataFrame) -> DataFrame:
    """Rows kept in the shared checkpoint folder; later steps restart from there."""
    return cut_lineage(df)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as lower-cased bytes."""
    return [] if text is None else text.encode().translate(WORD_BYTES).split()


class Recent(dict):
    """Two generations of remembered values: the older one goes when the newer one is full."""

    def __init__(self, make, size: int = 300_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def text_pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int):
    """Arrow batches cut so that their texts hold about ``most_bytes``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, one table per key, across batch borders."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns))
        start = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[start]:
                continue
            if held and marks[start] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = marks[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b): one row (node, root) per node, root the smallest node.

    Labels move along edges and then jump to their label's label, so paths shrink by more than
    half per round. Each round is stored; only a count reaches the driver.
    """
    both = stored(
        edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*").where("a <> b").distinct()
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("root"))
    )
    for _ in range(rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        )
        moved = labels.join(near, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "low").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        now = stored(
            moved.join(jump, "mid").select("node", "was", F.least("mid", "far").alias("root"))
        )
        labels = now.select("node", "root")
        if now.where("root <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
