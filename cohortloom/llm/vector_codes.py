"""Vector codes: equal parts of integer vectors, each named by its nearest codebook entry, by ball k-means.

Every part position has its own codebook, which starts as that part of the rows with the smallest ids
and is moved to its members' floored means a fixed number of times. Assignments are exact, but few
distances are computed. An entry with the parts assigned to it so far is a ball: its radius, the
distance of its farthest member, makes neighbours of those entries that are at most twice as far
away, since no other can be nearer to any member. Members that are nearer to their entry than half the
way to its nearest neighbour are its stable core and need no work. The others lie in rings: a member
is compared with just those neighbours, nearest first, that are at most twice its own distance away.
The first assignment starts from a guess, later ones from the codes so far; any start gives the same
codes.

Rows are passed once per round, in place: each task adds up its members' components, one row per part and
entry is shuffled, and only codebooks reach the driver. The rows with their codes so far are stored.

Defined results. Rows whose vector is null or holds null or non-finite components are dropped. Other
rows all count, repeated and null ids too (null ids after others, equal ids by their vectors). A
shorter vector is filled with zeros up to the longest kept one's length, rounded up to whole parts. With
fewer rows than entries there are so many entries. Scaled components beyond 2**26 count as 2**26.
``label_error`` adds equal labels, nulls together; it is null if it passes 64 bits. Other columns
never matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import query, read, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 26
#: The guess looks at so many neighbours of an entry, so many times.
WALK, WIDE = 2, 6
#: Label totals are copied so many times, so that a frequent label's rows meet them in several tasks.
SALTS = 8


def _squared(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(-1)


class Balls:
    """One part's entries and, for each, the others by distance."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = _squared(book[:, None] - book[None])
        np.fill_diagonal(apart, -1)
        self.near = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.near, 1)

    def guess(self, points: np.ndarray) -> np.ndarray:
        """An entry near the point: by the axis on which the entries differ most, then from neighbour to neighbour."""
        if not self.book.shape[1]:
            return np.zeros(len(points), int)
        axis = int(np.argmax(self.book.max(0) - self.book.min(0)))
        order = np.argsort(self.book[:, axis], kind="stable")
        values = self.book[order, axis]
        place = np.clip(np.searchsorted(values, points[:, axis]), 1, max(len(values) - 1, 1))
        place = np.minimum(place, len(values) - 1)
        before = np.maximum(place - 1, 0)
        nearer = points[:, axis] - values[before] < values[place] - points[:, axis]
        at = order[np.where(nearer, before, place)]
        distance = _squared(points - self.book[at])
        for _ in range(WALK):
            start = at
            for step in range(min(WIDE, self.near.shape[1])):
                entry = self.near[start, step]
                there = _squared(points - self.book[entry])
                better = there < distance
                at, distance = np.where(better, entry, at), np.where(better, there, distance)
        return at

    def assign(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each point (lowest of equals), its squared distance, and the distances computed."""
        best = _squared(points - self.book[at])
        radius = np.zeros(len(self.book), np.int64)
        np.maximum.at(radius, at, best)
        rings = np.zeros(len(points), int)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(self.book)))
        for entry, members in enumerate(np.split(order, ends[:-1])):
            neighbours = np.searchsorted(self.apart[entry], 4 * radius[entry], side="right")
            if neighbours and len(members):
                rings[members] = np.searchsorted(self.apart[entry, :neighbours], 4 * best[members], side="right")
        code = at.copy()
        outer = np.argsort(-rings, kind="stable")
        outer = outer[: np.count_nonzero(rings)]
        fewest = rings[outer]
        for ring in range(int(fewest[0]) if len(outer) else 0):
            members = outer[: np.searchsorted(-fewest, -ring, side="left")]
            entry = self.near[at[members], ring]
            distance = _squared(points[members] - self.book[entry])
            better = (distance < best[members]) | ((distance == best[members]) & (entry < code[members]))
            best[members[better]] = distance[better]
            code[members[better]] = entry[better]
        return code, best, len(points) + int(rings.sum())


def _cells(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("cells").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _code(books: np.ndarray, width: int, last: bool):
    """Rows with their codes under ``books``, (part, entry, component); the last pass adds the error."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(book) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _cells(batch, width).reshape(batch.num_rows, len(books), -1)
            before = None
            if "code" in batch.schema.names:
                before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
            codes = np.zeros((batch.num_rows, len(books)), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for part, ball in enumerate(balls):
                own = np.ascontiguousarray(points[:, part])
                at = ball.guess(own) if before is None else before[:, part].astype(int)
                codes[:, part], distance, _ = ball.assign(own, at)
                error += distance
            rows = [batch.column("id"), batch.column("label")]
            if last:
                names = ["id", "label", "code", "error"]
                rows += [pa.array([c.tobytes().hex() for c in codes]), pa.array(error)]
            else:
                names = ["id", "label", "cells", "code"]
                rows += [batch.column("cells"), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names)

    return code


def _sums(shape: tuple[int, int, int]):
    """One row per part and entry that a task met: members and sums of their components."""
    parts, entries, size = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(parts * entries, np.int64)
        sums = np.zeros((parts * entries, size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            slot = (codes + entries * np.arange(parts)).ravel()
            counts += np.bincount(slot, minlength=len(counts))
            points = _cells(batch, parts * size).reshape(-1, size)
            np.add.at(sums, slot, points)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(counts[met]), *(pa.array(c[met]) for c in sums.T)],
            ["slot", "n", *(f"s{i}" for i in range(size))],
        )

    return add


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at their members' floored means; entries without members stay."""
    parts, entries, size = books.shape
    names = ["n", *(f"s{i}" for i in range(size))]
    partial = rows.select("cells", "code").mapInArrow(
        _sums(books.shape), "slot int, " + ", ".join(f"{c} bigint" for c in names)
    )
    books = books.reshape(-1, size).copy()
    for row in partial.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).collect():
        books[row["slot"]] = [row[c] // row["n"] for c in names[1:]]
    return books.reshape(parts, entries, size)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """(id, label, cells) of the rows that take part, and the common length."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector")
    )
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    whole = F.transform(
        "vector", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    )
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size("vector")))
    return kept.select("id", "label", filled.alias("cells")), width


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every kept row, and the codebooks (part, entry, component); at most 256 entries."""
    cells, width = integer_vectors(vectors, id_col, vector_col, label_col, parts)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    head = f"id {kinds['id']}, label {kinds['label']}"
    first = cells.orderBy(F.col("id").asc_nulls_last(), "cells").limit(entries).select("cells").collect()
    books = np.array([r["cells"] for r in first], np.int64).reshape(len(first), parts, -1 if len(first) and width else 0)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    rows = cells
    if not first:
        none = cells.sparkSession.createDataFrame([], f"{head}, code string, error bigint")
        return none, books
    if not width:
        # only empty vectors
        return cells.select("id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("bigint").alias("error")), books
    for _ in range(rounds):
        rows = stored(rows.mapInArrow(_code(books, width, False), f"{head}, cells array<int>, code binary"))
        books = _moved(rows, books)
    return stored(rows.mapInArrow(_code(books, width, True), f"{head}, code string, error bigint")), books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Coded rows with the error summed over their label; frequent labels are salted."""
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(
        F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("to")
    )
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    return salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to"))).drop("of", "to", "salt")


def _distance() -> str:
    return " + ".join(f"(p.x{i} - b.x{i}) * (p.x{i} - b.x{i})" for i in range(1, 5))


def _sql() -> str:
    """The same rows over the given tables, whose vectors have 64 components."""
    xs = ", ".join(f"v[part * 4 + {i}] AS x{i}" for i in range(1, 5))
    steps = ""
    for k in range(ROUNDS + 1):
        steps += f""",
a{k} AS (SELECT r, part, min({{'d': d, 'e': e}}) AS m FROM (
  SELECT r, p.part, e, {_distance()} AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY r, part)"""
        if k < ROUNDS:
            mean = ", ".join(f"coalesce(s.x{i}, b.x{i}) AS x{i}" for i in range(1, 5))
            floors = ", ".join(f"CAST(floor(CAST(sum(x{i}) AS DOUBLE) / count(*)) AS BIGINT) AS x{i}" for i in range(1, 5))
            steps += f""",
b{k + 1} AS (SELECT b.part, b.e, {mean} FROM b{k} b LEFT JOIN (
  SELECT p.part, a.m.e AS e, {floors} FROM p JOIN a{k} a USING (r, part) GROUP BY ALL) s USING (part, e))"""
    cells = " || ',' || ".join(f"x{i}" for i in range(1, 5))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
           [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
      FROM embeddings WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, part, {xs} FROM k, (SELECT unnest(generate_series(0, {PARTS - 1})) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x1, x2, x3, x4 FROM p WHERE r <= {ENTRIES}){steps},
c AS (SELECT r, string_agg(printf('%02x', CAST(m.e AS INT)), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error
      FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg({cells}, ',' ORDER BY part, e)) AS s FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM k JOIN c USING (r) CROSS JOIN h"""


@query("op11_vector_code_compression", _sql())
def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
