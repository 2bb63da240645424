"""Benchmark decontamination by Wu-Manber multi-pattern search.

The windows of the benchmark items are the patterns, written as ``" w1 w2 ... "``. They are put
into classes of similar length. Each class has a block-shift table (how far a search may move on
after seeing a block of bytes) and buckets of patterns by the hash of the block that ends their
searched prefix; a shift of 0 selects a bucket and direct comparison confirms. A batch of texts is
searched by many cursors at once, each moving through its own lane of the buffer by table shifts.

Patterns are broadcast in blocks of at most ``PATTERN_BYTES``; a larger benchmark takes several
passes over each row, one per block, within the same stage.

Null texts have no words. Null or empty items have no window. Equal windows count for every item
that has them; items with the same id count once. Repeated documents give a row each.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import query, read, text_of, text_pieces, words_of

WINDOW = 10
PATTERN_BYTES = 8_000_000
BATCH_BYTES = 4_000_000
LANES = 8192
BLOCK = 8
BITS = 20


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Patterns of an item: every ``size`` words in a row, or all words of a shorter item."""
    if not words:
        return []
    count = max(1, len(words) - size + 1)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(count)]


class Tables:
    """Shift table and buckets of patterns whose lengths lie within a factor of two."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.reach = min(map(len, patterns))
        self.block = min(BLOCK, self.reach)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        most = self.reach - self.block + 1
        self.shift = np.full(1 << BITS, min(most, 255), np.uint8)
        head = np.frombuffer(b"".join(p[: self.reach] for p in patterns) + bytes(8), np.uint8)
        values = self.values(head)
        at = np.arange(len(patterns), dtype=np.int64) * self.reach
        for start in range(most):  # later blocks allow smaller shifts
            slots = self.slot(values[at + start])
            self.shift[slots] = np.minimum(self.shift[slots], min(most - 1 - start, 255))
        self.buckets = defaultdict(list)
        for i, value in enumerate(values[at + most - 1].tolist()):
            self.buckets[value].append(i)

    def values(self, buffer: np.ndarray) -> np.ndarray:
        """The block that starts at each byte, as a number."""
        wide = np.ndarray((len(buffer) - 7,), "<u8", buffer.data, strides=(1,))
        return wide & self.mask

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)

    def search(self, data: bytes, buffer: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence in ``data``; ``buffer`` is its padded array."""
        span = len(data) - self.reach + 1
        if span < 1:
            return
        values = np.ndarray((len(buffer) - 7,), "<u8", buffer.data, strides=(1,))
        lanes = min(LANES, span)
        edges = np.linspace(0, span, lanes + 1).astype(np.int64)
        at, end = edges[:-1].copy(), edges[1:]
        back = self.reach - self.block
        found = []
        while len(at):
            shift = self.shift[self.slot(values[at + back] & self.mask)]
            zero = shift == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(shift, 1)
            still = at < end
            at, end = at[still], end[still]
        if not found:
            return
        places = np.concatenate(found)
        blocks = (values[places + back] & self.mask).tolist()
        for place, block in zip(places.tolist(), blocks):
            for i in self.buckets.get(block, ()):
                if data.startswith(self.patterns[i], place):
                    yield place, i


class Searcher:
    """All length classes of one block of patterns, each pattern with its items."""

    def __init__(self, owned: Iterable[tuple[bytes, list[str]]]):
        classes = defaultdict(list)
        self.items = {}
        for pattern, items in owned:
            classes[len(pattern).bit_length()].append(pattern)
            self.items[pattern] = items
        self.tables = [Tables(patterns) for patterns in classes.values()]

    def search(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        buffer = np.frombuffer(data + bytes(8), np.uint8)
        for tables in self.tables:
            for start, i in tables.search(data, buffer):
                yield start, tables.patterns[i]


def pattern_blocks(items: DataFrame, item_col: str, size: int, block_bytes: int):
    """Blocks of (pattern, item ids) of bounded size; the benchmark is read part by part."""
    block: dict[bytes, set[str]] = {}
    held = 0
    rows = items.select(F.col(item_col).cast("string").alias("item"), text_of().alias("text"))
    for row in rows.where("item IS NOT NULL").toLocalIterator():
        for pattern in windows(words_of(row["text"]), size):
            if pattern not in block:
                block[pattern] = set()
                held += len(pattern) + 200
            block[pattern].add(row["item"])
        if held >= block_bytes:
            yield [(p, sorted(i)) for p, i in block.items()]
            block, held = {}, 0
    if block:
        yield [(p, sorted(i)) for p, i in block.items()]


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            parts, starts, at = [], [], 0
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                part = b" " + b" ".join(words) + b" " if words else b""
                parts.append(part)
                starts.append(at)
                at += len(part)
            data = b"".join(parts)
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            occurrences = list(searcher.search(data))
            if occurrences:
                spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
                places = np.array([s for s, _ in occurrences])
                rows = np.searchsorted(starts, places, side="right") - 1
                firsts = np.searchsorted(spaces, places) - np.searchsorted(spaces, np.array(starts)[rows])
                for (_, pattern), row, first in zip(occurrences, rows.tolist(), firsts.tolist()):
                    hits[row].append(first)
                    hits[row].append(first + pattern.count(b" ") - 1)
                    items[row].extend(searcher.items[pattern])
                for row in set(rows.tolist()):
                    pairs = sorted(set(zip(hits[row][::2], hits[row][1::2])))
                    hits[row] = [x for pair in _joined(pairs) for x in pair]
                    items[row] = sorted(set(items[row]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-2],
                    pa.array(hits, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=batch.schema.names,
            )

    return scan


def _joined(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted half-open spans with touching ones joined."""
    joined: list[list[int]] = []
    for first, end in pairs:
        if joined and first <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([first, end])
    return joined


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        n_words = [len(words_of(t)) for t in batch.column("text").to_pylist()]
        spans = [_joined(sorted(zip(h[::2], h[1::2]))) for h in hits]
        n_hit = [sum(b - a for a, b in s) for s in spans]
        sets = [sorted(set(i)) for i in items]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in sets]),
                pa.array([n > 0 for n in n_hit]),
                pa.array([[x for pair in s for x in pair] for s in spans], pa.list_(pa.int32())),
                pa.array(sets, pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
        )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """Per document: words, hit words, items that occur, and the hit word spans and item ids."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", text_of().alias("text"),
        F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    schema = f"doc_id {kind}, text string, hits array<int>, items array<string>"
    for block in pattern_blocks(benchmark, "item_id", size, block_bytes):
        rows = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block)), schema)
    return rows.mapInArrow(
        _finish,
        f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
        "contaminated boolean, spans array<int>, items array<string>",
    )


def _kept(shared):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            parts = [b" " + b" ".join(words_of(t)) + b" " for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            data = b"".join(parts)
            hit = {start for start, _ in searcher.search(data)}
            clean = np.ones(batch.num_rows, bool)
            clean[np.searchsorted(starts, sorted(hit), side="right") - 1] = False
            yield batch.filter(pa.array(clean))

    return keep


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """Rows in which no window occurs, with all their columns; one pass, no shuffle."""
    context = docs.sparkSession.sparkContext
    for block in pattern_blocks(benchmark, "item_id", size, block_bytes):
        docs = docs.mapInArrow(_kept(context.broadcast(block)), docs.schema)
    return docs


WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, {WORD}) AS w
           FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT item, len(w) AS k, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i
      FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, least(k, {WINDOW}) AS k,
             array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s FROM g),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
e AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
      FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
o AS (SELECT r, i, e.k, item FROM e JOIN p
      ON e.k = p.k AND array_to_string(w[i : i + e.k - 1], ' ') = s),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
      FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


@query("op5_benchmark_decontamination", SQL)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
