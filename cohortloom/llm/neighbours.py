"""Approximate nearest neighbours by a hash-prefix forest.

Equal vectors are one candidate with its smallest ids. The distinct vectors stay where they are, in
shards of at most ``SHARD`` rows; each shard builds its own forest: per tree the vectors' long hash
strings (signs of random projections) in a sorted array. A query descends in every tree to its
longest matching prefix, which gives a first answer; then all trees ascend together, one bit at a
time, and take in the vectors that share the shorter prefix. The ascent ends at the depth at which
a vector as near as the query's current k-th best would have been met in some tree with probability
``SURE``. So the number of candidates follows from the data, with no budget to tune.

Queries are broadcast in blocks of ``QUERY_BLOCK`` vectors; each block is one pass over the shards.
Rows whose vector or id is null, or whose vector is empty, zero or not finite, take no part. Only
vectors of the same length are compared. Repeated rows count once. Ties go to the smaller id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import query, read, stored

TREES = 48
DEPTH = 48
SURE = 0.97
SHARD = 32_768
QUERY_BLOCK = 16_384
TASK_QUERIES = 512
EVERY = 50
NEAREST = 5
FIRST = 4


def hash_strings(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """(tree, vector) hash strings as unsigned numbers, first bit highest."""
    rng = np.random.default_rng(seed)
    found = np.zeros((TREES, len(vectors)), np.uint64)
    for tree in range(TREES):
        signs = vectors @ rng.standard_normal((vectors.shape[1], DEPTH)) > 0
        for bit in range(DEPTH):
            found[tree] = found[tree] << np.uint64(1) | signs[:, bit].astype(np.uint64)
    return found


def depth_for(cosine: np.ndarray) -> np.ndarray:
    """Deepest level at which all trees together meet a vector of this cosine surely enough."""
    same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    per_tree = 1 - (1 - SURE) ** (1 / TREES)
    with np.errstate(divide="ignore"):
        depth = np.log(per_tree) / np.log(np.minimum(same, 1 - 1e-12))
    return np.clip(np.floor(depth), 0, DEPTH).astype(int)


class Forest:
    def __init__(self, units: np.ndarray, seed: int = 11):
        self.units = units
        strings = hash_strings(units, seed)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tree, query) places of the vectors that share each query's first ``depth`` bits."""
        drop = (DEPTH - depth).astype(np.uint64)
        low = strings >> drop << drop
        high = low | ((np.uint64(1) << drop) - np.uint64(1))
        first = np.stack([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, low)])
        last = np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, high)])
        return first, last

    def nearest(self, units: np.ndarray, strings: np.ndarray, k: int):
        """Per query the places of its ``k`` nearest candidates, nearest first."""
        size = len(self.units)
        k = min(k, size)
        # descent: the neighbours in sorted order share the longest prefixes
        at = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, strings)])
        near = np.clip(at[:, :, None] + np.arange(-FIRST, FIRST), 0, size - 1)
        firsts = np.take_along_axis(self.order[:, None, :], near.reshape(TREES, 1, -1), 2)
        firsts = firsts.reshape(TREES, len(units), -1).transpose(1, 0, 2).reshape(len(units), -1)
        bound = np.empty(len(units))
        for i, places in enumerate(firsts):
            scores = self.units[np.unique(places)] @ units[i]
            bound[i] = np.sort(scores)[-min(k, len(scores))]
        # ascent: every tree takes in what shares the prefix of the depth that the bound asks for
        depth = depth_for(bound)
        first, last = self.ranges(strings, depth)
        for i in range(len(units)):
            met = np.zeros(size, bool)
            met[firsts[i]] = True
            for tree in range(TREES):
                met[self.order[tree, first[tree, i] : last[tree, i]]] = True
            places = np.flatnonzero(met)
            scores = self.units[places] @ units[i]
            # a little more than k, so that the exact order is settled afterwards
            cut = np.partition(scores, -min(k, len(scores)))[-min(k, len(scores))] - 1e-9
            yield places[scores >= cut]


def cosines(vectors: np.ndarray, vector: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * np.sqrt(vector @ vector)
    return np.einsum("ij,j->i", vectors, vector) / sizes


def _search(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = defaultdict(list)
        for query_id, vector in shared.value:
            by_size[len(vector)].append((query_id, vector))
        held = defaultdict(list)
        for batch in batches:
            for ids, vector in zip(batch.column("ids").to_pylist(), batch.column("vector").to_pylist()):
                rows = held[len(vector)]
                rows.append((ids, vector))
                if len(rows) == SHARD:
                    yield from answers(by_size[len(vector)], held.pop(len(vector)))
        for size, rows in held.items():
            yield from answers(by_size[size], rows)

    def answers(queries, rows):
        if not queries:
            return
        vectors = _scaled(np.array([v for _, v in rows], float))
        units = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        forest = Forest(units)
        for start in range(0, len(queries), TASK_QUERIES):
            part = queries[start : start + TASK_QUERIES]
            asked = _scaled(np.array([v for _, v in part], float))
            asked_units = asked / np.sqrt(np.einsum("ij,ij->i", asked, asked))[:, None]
            strings = hash_strings(asked_units)
            found = ([], [], [])
            # one class more: the query's own may hold nothing but the query
            for (query_id, _), vector, places in zip(part, asked, forest.nearest(asked_units, strings, k + 1)):
                for place, score in zip(places.tolist(), cosines(vectors[places], vector).tolist()):
                    ids = [i for i in rows[place][0] if i != query_id][:k]
                    found[0].extend([query_id] * len(ids))
                    found[1].extend(ids)
                    found[2].extend([score] * len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
                ["query_id", "vec_id", "score"],
            )

    return search


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Very large or small vectors brought near 1 by a power of two, which keeps cosines as they are."""
    largest = np.abs(vectors).max(1)
    power = np.where((largest > 1e100) | (largest < 1e-100), -np.frexp(largest)[1], 0)
    return np.ldexp(vectors, power[:, None])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows that take part; repeated rows are still there."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return vectors.where(
        F.col(id_col).isNotNull() & F.coalesce(finite & some, F.lit(False))
    ).select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"))


def nearest_neighbours(
    vectors: DataFrame, every: int = EVERY, k: int = NEAREST,
    id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    # each (vector, id) once, so that repeated rows take no places from other ids
    rows = usable(vectors, id_col, vector_col).groupBy("vector", "id").agg(F.lit(1).alias("one"))
    # equal vectors: their k + 1 smallest ids, cut within each partition before the shuffle
    number = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    same = rows.withColumn("n", number).where(F.col("n") <= k + 1)
    distinct = stored(same.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    asked = stored(rows.where(F.col("id") % every == 0))
    count = asked.count()
    blocks = max(1, -(-count // block))
    found = None
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        queries = sorted((r["id"], r["vector"]) for r in part.select("id", "vector").collect())
        answers = distinct.mapInArrow(
            _search(spark.sparkContext.broadcast(queries), k), "query_id bigint, vec_id bigint, score double"
        )
        found = answers if found is None else found.union(answers)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op4_approximate_nearest_neighbours")
def op4_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))
