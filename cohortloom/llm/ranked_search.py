"""Ranked lexical search by hashed max-sketches.

A document's terms are hashed to ``WIDTH`` coordinates, and its sketch keeps, for each coordinate that is met,
the largest number of occurrences of its terms. A term's impact grows with its occurrences, so this is
the coordinatewise maximum of impacts too, whatever the corpus counts turn out to be. Looking up the
coordinates of a query's terms and adding weight times impact gives a bound that no score exceeds; the lookups
of a whole block of queries are one sparse product over a batch of sketches.

Documents are then scored exactly in descending order of their bounds until the next bound is below the k-th
best score. A first pass over the sketches takes the documents with the highest bounds of all, scores
them, and so gives every query a score that k documents reach. A second pass starts from there: each task
goes on with its own sketches, and only documents whose bound reaches the threshold are unpacked
and scored. Bounds and scores are whole numbers, so ties are settled by id as if all had been scored.

Sketches are a stored table next to the compressed words. Queries are broadcast in blocks of bounded size; a
task returns at most k documents per query, and nothing per pair of query and document is ever made.

Defined results. Null and empty texts have no terms, and a query without known terms has no rows. Rows of
documents count one by one, repeated or not. Queries equal in id and text count once; the same id with
several texts gets one list per text. Null ids come after all others. Other columns never matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortloom.llm.common import Recent, query, read, stored, text_pieces, words_of

NEAREST = 50
WIDTH = 65_536
#: Occurrences from here on count as unlimited in a sketch.
MANY = 65_535
LIMIT = 1_000_000
BATCH_BYTES = 4_000_000
#: Numbers in one dense block of bounds.
BOUNDS = 4_000_000
#: A block of queries has about so many terms and queries.
BLOCK_TERMS = 1_000_000
BLOCK_QUERIES = 4_096


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % WIDTH


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_term(n: int, documents: int, total: int) -> int:
    return 50 + (50 * n * documents) // total


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = Recent(coordinate)
    press = zstandard.ZstdCompressor(level=1)
    for batch in text_pieces(batches, "text", BATCH_BYTES):
        sizes, coords, tops, packed = [], [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            counts = Counter(words)
            at = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
            often = np.fromiter(counts.values(), np.int64, len(counts))
            order = np.lexsort((-often, at))
            at, first = np.unique(at[order], return_index=True)
            sizes.append(len(words))
            coords.append(at.astype("<u2").tobytes())
            tops.append(np.minimum(often[order][first], MANY).astype("<u2").tobytes())
            packed.append(press.compress(b" ".join(words)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (coords, tops, packed))],
            ["doc_id", "n", "coords", "tops", "packed"],
        )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n, coords, tops, packed of every document; stored. ``row`` is unique."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_sketch, f"doc_id {kind}, n bigint, coords binary, tops binary, packed binary")
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def unpacked(packed: bytes) -> Counter:
    """Occurrences of a document's terms."""
    return Counter(zstandard.ZstdDecompressor().decompress(packed).split())


class Queries:
    """A block of queries with the weights of their terms, and what the corpus has in all."""

    def __init__(self, terms: list[dict[bytes, int]], documents: int, total: int):
        self.terms, self.documents, self.total = terms, documents, total
        items, places, weights = [], [], []
        for item, weighted in enumerate(terms):
            # a coordinate that several terms of a query share counts with all their weights
            at = defaultdict(int)
            for term, weight in weighted.items():
                at[coordinate(term)] += weight
            items += [item] * len(at)
            places += at
            weights += at.values()
        places = np.array(places, np.int64)
        order = np.argsort(places, kind="stable")
        self.items = np.array(items, np.int64)[order]
        self.weights = np.array(weights, float)[order]
        self.size = np.bincount(places, minlength=WIDTH)
        self.start = np.cumsum(self.size) - self.size

    def bounds(self, sizes: list[int], coords: list[bytes], tops: list[bytes]) -> np.ndarray:
        """(document, query) numbers that no score exceeds."""
        owner = np.repeat(np.arange(len(coords)), [len(c) // 2 for c in coords])
        m = np.array([length_term(n, self.documents, self.total) for n in sizes], np.int64)[owner]
        at = np.frombuffer(b"".join(coords), "<u2").astype(np.int64)
        tf = np.frombuffer(b"".join(tops), "<u2").astype(np.int64)
        wanted = np.flatnonzero(self.size[at])
        owner, m, at, tf = owner[wanted], m[wanted], at[wanted], tf[wanted]
        value = np.where(tf == MANY, LIMIT, impact(tf, m)).astype(float)
        reps = self.size[at]
        ends = np.cumsum(reps)
        post = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - reps - self.start[at], reps)
        cell = np.repeat(owner, reps) * len(self.terms) + self.items[post]
        found = np.bincount(cell, np.repeat(value, reps) * self.weights[post], len(coords) * len(self.terms))
        # sums below 2**53 are whole; beyond, a little more than their rounding
        return np.ceil(found * (1 + (found > 2.0**52) * 1e-9)).reshape(len(coords), len(self.terms))

    def score(self, item: int, counts: Counter, n: int) -> int:
        m = length_term(n, self.documents, self.total)
        return sum(w * impact(counts[t], m) for t, w in self.terms[item].items() if t in counts)

    def batches(self, batches: Iterator[pa.RecordBatch]):
        """Stored rows in pieces, each with its bounds."""
        most = max(1, BOUNDS // max(1, len(self.terms)))
        for batch in text_pieces(batches, "packed", BATCH_BYTES):
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                yield part, self.bounds(*(part.column(c).to_pylist() for c in ("n", "coords", "tops")))


def _lead(shared, most: int):
    """A task's documents with the highest bounds of each query."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = np.zeros((0, len(queries.terms)))
        rows = np.zeros((0, len(queries.terms)), np.int64)
        for part, bounds in queries.batches(batches):
            own = np.repeat(part.column("row").to_numpy()[:, None], bounds.shape[1], 1)
            best, rows = np.vstack([best, bounds]), np.vstack([rows, own])
            if len(best) > most:
                top = np.argpartition(-best, most, axis=0)[:most]
                best, rows = np.take_along_axis(best, top, 0), np.take_along_axis(rows, top, 0)
        at, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(rows[at, item]), pa.array(best[at, item])], ["item", "row", "bound"]
        )

    return lead


def _score(shared):
    """Exact scores of given documents for given queries."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            found = ([], [])
            for n, packed, items in zip(*(batch.column(c).to_pylist() for c in ("n", "packed", "items"))):
                counts = unpacked(packed)
                for item in items:
                    found[0].append(item)
                    found[1].append(queries.score(item, counts, n))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64())], ["item", "score"])

    return score


class Best:
    """The k best (score, id, row) of a query: highest score, then smallest id, null ids last."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.held = k, least, []

    def take(self, score: int, doc_id, row: int) -> None:
        if score < max(self.least, 1):
            return
        self.held.append((-score, doc_id is None, 0 if doc_id is None else doc_id, row))
        if len(self.held) >= 2 * self.k:
            self.settle()

    def settle(self) -> list[tuple]:
        self.held.sort()
        del self.held[self.k :]
        if len(self.held) == self.k:
            self.least = max(self.least, -self.held[-1][0])
        return self.held


def _rescore(shared, least: list[int], k: int, kind: pa.DataType):
    """A task's k best documents of each query among those that may reach the query's threshold."""

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [Best(k, x) for x in least]
        for part, bounds in queries.batches(batches):
            ids, sizes, packed, rows = (part.column(c).to_pylist() for c in ("doc_id", "n", "packed", "row"))
            known: dict[int, Counter] = {}
            reach = bounds >= np.array([max(b.least, 1) for b in best], float)
            for item in np.flatnonzero(reach.any(0)).tolist():
                places = np.flatnonzero(reach[:, item])
                for place in places[np.argsort(-bounds[places, item], kind="stable")].tolist():
                    if bounds[place, item] < best[item].least:
                        break
                    if place not in known:
                        known[place] = unpacked(packed[place])
                    best[item].take(queries.score(item, known[place], sizes[place]), ids[place], rows[place])
        listed = [(item, *h) for item, b in enumerate(best) for h in b.settle()]
        if listed:
            item, score, none, doc_id, row = zip(*listed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item, pa.int32()), pa.array([-s for s in score], pa.int64()),
                    pa.array([None if x else i for x, i in zip(none, doc_id)], kind), pa.array(row, pa.int64()),
                ],
                ["item", "score", "doc_id", "row"],
            )

    return rescore


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = [sorted(set(words_of(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("key"), pa.array(listed, pa.list_(pa.binary()))], ["item_id", "key", "terms"]
        )


def _document_counts(shared):
    """Documents of this task that hold each of the given terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        holders = np.zeros(len(numbers), np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                met = [numbers[w] for w in set(unpack(packed).split()) if w in numbers]
                holders[met] += 1
        met = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(holders[met])], ["number", "df"])

    return count


def query_blocks(items: DataFrame, id_col: str, text_col: str, most_terms: int, most: int) -> Iterator[list]:
    """Lists of (item id, text key, terms) of bounded size."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    terms = stored(rows.withColumn("key", F.md5("text")).mapInArrow(_terms, f"item_id {kind}, key string, terms array<binary>"))
    terms = terms.where(F.size("terms") > 0)
    count, total = terms.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(-(-(total or 0) // most_terms), -(-count // most))
    for number in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("item_id", "key"), F.lit(blocks)) == number)
        yield [(r["item_id"], r["key"], [bytes(t) for t in r["terms"]]) for r in part.collect()]


def weigh(spark: SparkSession, table: DataFrame, block: list, documents: int, total: int) -> Queries:
    """The block's terms with the weights that their documents give them."""
    listed = sorted({t for _, _, terms in block for t in terms})
    numbers = {t: i for i, t in enumerate(listed)}
    partial = table.select("packed").mapInArrow(_document_counts(spark.sparkContext.broadcast(numbers)), "number bigint, df bigint")
    weights = {}
    for number, df in partial.groupBy("number").agg(F.sum("df")).collect():
        weight = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        if weight:
            weights[listed[number]] = weight
    return Queries([{t: weights[t] for t in terms if t in weights} for _, _, terms in block], documents, total)


def thresholds(spark: SparkSession, table: DataFrame, queries: Queries, k: int) -> list[int]:
    """For each query a score that k documents reach, 0 if the first pass finds fewer."""
    shared = spark.sparkContext.broadcast(queries)
    # so many per task that all together have several times k
    most = min(k, max(5, -(-4 * k // max(1, table.rdd.getNumPartitions()))))
    lead = table.select("row", "n", "coords", "tops", "packed").mapInArrow(
        _lead(shared, most), "item int, row bigint, bound double"
    )
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "row"))
    chosen = (
        lead.withColumn("place", place).where(F.col("place") <= k)
        .groupBy("row").agg(F.collect_list("item").alias("items"))
    )
    # at most k rows for each query of the block
    scores = table.join(F.broadcast(chosen), "row").select("n", "packed", "items").mapInArrow(
        _score(shared), "item int, score bigint"
    )
    least = [0] * len(queries.terms)
    for row in scores.groupBy("item").agg(F.count("*").alias("many"), F.min("score").alias("score")).collect():
        if row["many"] >= k:
            least[row["item"]] = row["score"]
    return least


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = NEAREST, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """item_id, text_key (of the item), rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    table = sketches(docs, doc_id, doc_text)
    documents, total = table.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds = [docs.schema[doc_id].dataType, items.schema[item_id].dataType.simpleString()]
    found = spark.createDataFrame(
        [], f"item_id {kinds[1]}, text_key string, rank int, doc_id {kinds[0].simpleString()}, score bigint"
    )
    for block in query_blocks(items, item_id, item_text, block_terms, block_queries) if documents else ():
        queries = weigh(spark, table, block, documents, total)
        least = thresholds(spark, table, queries, k)
        scored = table.mapInArrow(
            _rescore(spark.sparkContext.broadcast(queries), least, k, to_arrow_type(kinds[0])),
            f"item int, score bigint, doc_id {kinds[0].simpleString()}, row bigint",
        )
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(i, name, key) for i, (name, key, _) in enumerate(block)], f"item int, item_id {kinds[1]}, text_key string"
        )
        found = found.union(best.join(F.broadcast(names), "item").select("item_id", "text_key", "rank", "doc_id", "score"))
    return found


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {LETTERS}), {TERM}) AS w
           FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
t AS (SELECT DISTINCT q, unnest(regexp_extract_all(translate(text, {LETTERS}), {TERM})) AS term FROM i),
c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM t) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM c GROUP BY term), s),
m AS (SELECT r, doc_id, CAST(50 + (50 * len(w) * docs) // total AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT q, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM t JOIN c USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
      FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= {NEAREST}"""


@query("op12_ranked_lexical_search", SQL)
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "item_id", "rank", "doc_id", "score"
    )
