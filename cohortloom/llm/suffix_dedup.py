"""Removal of repeated byte strings by difference-cover blockwise suffix sorting.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else.

1. Every such string has an anchor: the smallest hash of its ``ANCHOR``-byte substrings, leftmost
   first. Equal strings have equal anchors at equal places. Anchors are found for all texts;
   only strings around anchors that occur more than once can repeat, so the rest is done.
2. An anchor hash names a bucket of suffixes: those that start around its occurrences. Contexts
   (the bytes around an occurrence) that are equal become one with a count.
3. Buckets are sorted one at a time, a few thousand contexts in memory. First, ranks of the
   suffixes at the columns of a difference cover are computed from right to left. A suffix is
   then ordered by the few bytes before its next cover column and, however long the tie, by the
   rank there. Neighbours in that order which agree in ``LENGTH`` bytes are repeated.
4. A bucket with more than ``LARGEST_BUCKET`` different contexts is split by longer prefixes: its
   contexts are cut into blocks of ``BLOCK`` starts, and the bytes that all strings of a block share
   name the new bucket. Equal blocks become one again. A bucket that is still too large is split
   once more, into blocks of one start; all strings of such a bucket are equal, so one context is left
   of it. Every bucket, however it came about, is sorted in the same way.

Texts are named by a digest, so equal texts are searched once; a text that occurs more than once
goes as a whole if it has ``LENGTH`` bytes. Null texts are empty texts. Each row gets a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import query, read, runs, stored, text_key, text_of, text_pieces

LENGTH = 400
ANCHOR = 48
SEGMENT = 1_000_000
PERIOD = 36
LARGEST_BUCKET = 512
BLOCK = 32
SORT_ROWS = 4096
BATCH_BYTES = 1_000_000
ANCHOR_TYPE = np.dtype([("hash", "<i8"), ("at", "<i4"), ("low", "<i4"), ("high", "<i4")])


def difference_cover(period: int) -> list[int]:
    """Residues whose differences reach every residue: a run of about sqrt(period), and its multiples."""
    k = int(np.ceil(np.sqrt(period)))
    return sorted({*range(k), *range(0, period, k)})


class Anchors:
    """Anchors of all ``length``-byte strings of a buffer."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.length, self.anchor = length, min(anchor, length)
        self.letters = rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        size = SEGMENT + length
        base = 0x9E3779B97F4A7C15
        self.up = np.full(size, base, np.uint64)
        self.up[0] = 1
        self.up = np.multiply.accumulate(self.up)
        self.down = np.full(size, pow(base, -1, 2**64), np.uint64)
        self.down[0] = 1
        self.down = np.multiply.accumulate(self.down)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.down[: len(data)], out=sums[1:])
        k = self.anchor
        found = (sums[k:] - sums[:-k]) * self.up[: len(data) - k + 1]
        found ^= found >> np.uint64(32)
        return found * np.uint64(0xD6E8FEB86659FD93)

    def of(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Anchors with the starts ``low..high`` of the strings that have them.

        ``ends`` are the ends of the texts in the buffer; strings do not cross them.
        """
        found = [self._segment(data, ends, s) for s in range(0, max(1, len(data) - self.length + 1), SEGMENT)]
        return np.concatenate(found)

    def _segment(self, data: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
        part = data[start : start + SEGMENT + self.length - 1]
        count = len(part) - self.length + 1
        if count < 1:
            return np.empty(0, ANCHOR_TYPE)
        hashes = self.hashes(part)
        width = self.length - self.anchor + 1
        low_bits = np.uint64(24)
        value = (hashes >> low_bits << low_bits) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(value) // width) * width, 2**64 - 1, np.uint64)
        padded[: len(value)] = value
        blocks = padded.reshape(-1, width)
        from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(from_right[:count], from_left[width - 1 : width - 1 + count])
        at = (least & np.uint64(2**24 - 1)).astype(np.int64)
        starts = np.arange(count)
        text = np.searchsorted(ends, start + starts, side="right")
        inside = start + starts + self.length <= ends[np.minimum(text, len(ends) - 1)]
        starts, at, text = starts[inside], at[inside], text[inside]
        if not len(starts):
            return np.empty(0, ANCHOR_TYPE)
        fresh = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])]
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(starts)] - 1
        found = np.empty(len(first), ANCHOR_TYPE)
        found["hash"] = hashes[at[first]].view(np.int64)
        found["at"] = at[first] + start
        found["low"] = starts[first] + start
        found["high"] = starts[last] + start
        return found


def _find_anchors(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length)
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            anchors = finder.of(data, ends)
            edges = np.searchsorted(anchors["low"], np.r_[0, ends])
            packed = []
            for start, a, b in zip(np.r_[0, ends[:-1]], edges[:-1], edges[1:]):
                own = anchors[a:b].copy()
                for name in ("at", "low", "high"):
                    own[name] -= start
                packed.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), pa.array(packed, pa.binary())], ["text_key", "anchors"]
            )

    return find


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and anchor hash, with all its anchors of that hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = [np.frombuffer(a, ANCHOR_TYPE) for a in batch.column("anchors").to_pylist()]
        every = np.concatenate(lists)
        if not len(every):
            continue
        owner = np.repeat(np.arange(len(lists)), [len(a) for a in lists])
        order = np.lexsort((every["at"], every["hash"], owner))
        every, owner = every[order], owner[order]
        first = np.flatnonzero(
            np.r_[True, (every["hash"][1:] != every["hash"][:-1]) | (owner[1:] != owner[:-1])]
        )
        edges = np.r_[first, len(every)]
        data, size = every.tobytes(), ANCHOR_TYPE.itemsize
        packed = [data[a * size : b * size] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("text_key").take(pa.array(owner[first])),
                pa.array(np.ascontiguousarray(every["hash"][first])),
                pa.array(np.diff(edges)), pa.array(packed, pa.binary()),
            ],
            ["text_key", "hash", "times", "packed"],
        )


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in text_pieces(batches, "text", BATCH_BYTES):
        squeezed = [press.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("text_key"), pa.array(squeezed, pa.binary())], ["text_key", "squeezed"]
        )


def _contexts(length: int, with_bytes: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Context of every repeated anchor: its bucket, digest and place, and its bytes if asked for."""
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                text = unpress.decompress(batch.column("squeezed")[row].as_py())
                found = np.frombuffer(b"".join(batch.column("found")[row].as_py()), ANCHOR_TYPE)
                hashes, low = found["hash"].tolist(), found["low"].tolist()
                before = (found["at"] - found["low"]).tolist()
                many = (found["high"] - found["low"] + 1).tolist()
                parts = [text[a : a + n + length - 1] for a, n in zip(low, many)]
                keys = [
                    hashlib.blake2b(p, digest_size=16, key=b"%d,%d,%d" % (h, b, n)).digest()
                    for p, h, b, n in zip(parts, hashes, before, many)
                ]
                columns = [pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())]
                names = ["hash", "context_key"]
                if with_bytes:
                    columns += [pa.array(before, pa.int32()), pa.array(many, pa.int32()), pa.array(parts, pa.binary())]
                    names += ["before", "many", "context"]
                else:
                    key = batch.column("text_key")[row].as_py()
                    columns += [pa.array([key] * len(low), pa.binary()), pa.array(low, pa.int32())]
                    names += ["text_key", "low"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def repeated_starts(contexts: list[bytes], before: np.ndarray, many: np.ndarray, times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its ``many`` first starts begin a string found elsewhere, too.

    Contexts are laid out as rows aligned at their anchors (``before`` bytes after their start).
    """
    most = int(before.max())
    sizes = np.array([len(c) for c in contexts])
    columns = int((most - before + sizes).max())
    table = np.zeros((len(contexts), columns + 8), np.uint8)
    for row, (context, shift) in enumerate(zip(contexts, most - before)):
        table[row, shift : shift + len(context)] = np.frombuffer(context, np.uint8)
    first = most - before
    last = first + many - 1
    residues = set(difference_cover(PERIOD))
    cover = [c for c in range(columns) if c % PERIOD in residues] + [columns]
    following = np.searchsorted(cover, np.arange(columns + 1))

    def ordered(column: int, until: int, rank: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bytes of ``column..until`` (at most 6) above the rank behind them, as one number."""
        key = rank[rows].astype(np.uint64)
        for place in range(until - 1, column - 1, -1):
            key |= table[rows, place].astype(np.uint64) << np.uint64(16 + 8 * (until - 1 - place))
        return key

    every = np.arange(len(contexts))
    ranks = {columns: np.zeros(len(contexts), np.uint16)}
    for here, behind in zip(cover[-2::-1], cover[:0:-1]):
        _, inverse = np.unique(ordered(here, behind, ranks[behind], every), return_inverse=True)
        ranks[here] = inverse.astype(np.uint16)
    repeated = [np.full(n, t > 1) for n, t in zip(many, times)]
    for column in range(int(first.min()), int(last.max()) + 1):
        rows = np.flatnonzero((first <= column) & (column <= last))
        if len(rows) < 2:
            continue
        behind = cover[following[column]]
        key = ordered(column, behind, ranks[behind], rows)
        order = rows[np.argsort(key, kind="stable")]
        strings = table[order, column : column + length]
        same = (strings[1:] == strings[:-1]).all(1)
        for row in order[np.r_[same, False] | np.r_[False, same]].tolist():
            repeated[row][column - first[row]] = True
    return repeated


def _stretches(mask: np.ndarray) -> np.ndarray:
    """(first, last) of every run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return np.c_[edges[::2], edges[1::2] - 1].astype(np.int32)


def _sort_buckets(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for bucket in runs(batches, ["hash"]):
            held.append(bucket)
            rows += bucket.num_rows
            if rows >= SORT_ROWS:
                yield solved(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield solved(pa.concat_tables(held))

    def solved(table: pa.Table) -> pa.RecordBatch:
        masks = repeated_starts(
            table.column("context").to_pylist(),
            *(table.column(c).to_numpy() for c in ("before", "many", "times")), length,
        )
        stretches = [_stretches(m).tobytes() for m in masks]
        keep = [i for i, s in enumerate(stretches) if s]
        keys = table.column("context_key").to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in keep], pa.binary()), pa.array([stretches[i] for i in keep], pa.binary())],
            ["context_key", "stretches"],
        )

    return sort


def _blocks(length: int, block: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts cut into blocks of starts, aligned at the anchor; each with its own bucket and digest."""
        names = ["context_key", "hash", "before", "many", "times"]
        for batch in batches:
            rows = ([], [], [], [], [], [], [], [])
            columns = [batch.column(n).to_pylist() for n in names]
            for key, bucket, before, many, times, context in zip(*columns, batch.column("context").to_pylist()):
                first = 0
                while first < many:
                    number = (first - before) // block
                    end = min(many, (number + 1) * block + before)
                    part = context[first : end - 1 + length]
                    # the bytes that every string starting in this block has, wherever it starts
                    start = number * block + before
                    core = context[start + block - 1 : start + length]
                    name = hashlib.blake2b(core, digest_size=8, key=b"%d,%d" % (bucket, number)).digest()
                    digest = hashlib.blake2b(part, digest_size=16, key=b"%d,%d,%d" % (bucket, before - first, end - first))
                    for values, value in zip(
                        rows,
                        (key, first, digest.digest(), int.from_bytes(name, "little", signed=True), before - first, end - first, times, part),
                    ):
                        values.append(value)
                    first = end
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(rows, kinds)],
                ["whole_key", "base", "context_key", "hash", "before", "many", "times", "context"],
            )

    return cut


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = ([], [], [], [])
            for row in range(batch.num_rows):
                text = unpress.decompress(batch.column("squeezed")[row].as_py())
                spans = []
                for mark in batch.column("marks")[row].as_py():
                    for first, last in np.frombuffer(mark["stretches"], np.int32).reshape(-1, 2).tolist():
                        spans.append((mark["low"] + first, mark["low"] + last + length))
                joined: list[list[int]] = []
                for first, end in sorted(spans):
                    if joined and first <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], end)
                    else:
                        joined.append([first, end])
                kept = hashlib.sha256()
                at = 0
                for first, end in joined:
                    kept.update(text[at:first])
                    at = end
                kept.update(text[at:])
                rows[0].append(sum(b - a for a, b in joined))
                rows[1].append(len(joined))
                rows[2].append(kept.hexdigest())
                rows[3].append([x for span in joined for x in span])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_key"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                    pa.array(rows[2], pa.string()), pa.array(rows[3], pa.list_(pa.int32())),
                ],
                ["text_key", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    return remove


def _sorted(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated stretches of the contexts of whole buckets."""
    return (
        contexts.repartition("hash").sortWithinPartitions("hash")
        .mapInArrow(_sort_buckets(length), "context_key binary, stretches binary")
    )


def _split(contexts: DataFrame, length: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the contexts, and the different ones among them with their numbers and their buckets' sizes."""
    blocks = stored(contexts.mapInArrow(
        _blocks(length, block),
        "whole_key binary, base int, context_key binary, hash bigint, before int, many int, "
        "times bigint, context binary",
    ))
    distinct = blocks.groupBy("context_key").agg(
        F.sum("times").alias("times"), F.first(F.struct("hash", "before", "many", "context")).alias("c")
    ).select("context_key", "times", "c.*")
    sizes = distinct.groupBy("hash").agg(F.count("*").alias("size"))
    return blocks, stored(distinct.join(sizes, "hash").where("size > 1 OR times > 1"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of stretches per context, whose starts are those of its blocks together."""
    for batch in batches:
        packed = []
        for marks in batch.column("marks").to_pylist():
            parts = [np.frombuffer(m["stretches"], np.int32).reshape(-1, 2) + m["base"] for m in marks]
            spans = np.concatenate(parts)
            mask = np.zeros(int(spans.max()) + 1, bool)
            for first, last in spans.tolist():
                mask[first : last + 1] = True
            packed.append(_stretches(mask).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("context_key"), pa.array(packed, pa.binary())], ["context_key", "stretches"])


def _whole(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks of blocks as marks of the contexts that they were cut from, one row each."""
    places = blocks.select("whole_key", "base", "context_key")
    return (
        places.join(marks, "context_key").groupBy(F.col("whole_key").alias("context_key"))
        .agg(F.collect_list(F.struct("base", "stretches")).alias("marks"))
        .mapInArrow(_merge, "context_key binary, stretches binary")
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans)."""
    texts = docs.select(
        "doc_id", text_of().alias("text"), text_key().alias("text_key"),
    )
    rows = stored(
        texts.select(
            "doc_id", "text_key", F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        )
    )
    counts = rows.where(F.col("n_bytes") >= length).groupBy("text_key").agg(F.count("*").alias("copies"))
    long = texts.where(F.octet_length("text") >= length).select("text_key", "text")
    anchors = stored(
        long.mapInArrow(_find_anchors(length), "text_key binary, anchors binary")
        .groupBy("text_key").agg(F.first("anchors").alias("anchors"))
    )
    spread = anchors.mapInArrow(_spread, "text_key binary, hash bigint, times bigint, packed binary")
    repeated = spread.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1").select("hash")
    found = (
        spread.join(repeated, "hash").groupBy("text_key")
        .agg(F.collect_list("packed").alias("found"))
    )
    part = stored(
        long.mapInArrow(_squeeze, "text_key binary, squeezed binary")
        .join(found, "text_key").groupBy("text_key")
        .agg(F.first("squeezed").alias("squeezed"), F.first("found").alias("found"))
    )
    places = stored(
        part.mapInArrow(
            _contexts(length, False), "hash bigint, context_key binary, text_key binary, low int"
        )
    )
    times = places.groupBy("hash", "context_key").agg(F.count("*").alias("times"))
    sizes = times.groupBy("hash").agg(F.count("*").alias("size"))
    times = times.join(sizes, "hash").select("context_key", "times", "size")
    contexts = (
        part.mapInArrow(
            _contexts(length, True),
            "hash bigint, context_key binary, before int, many int, context binary",
        )
        .groupBy("context_key")
        .agg(F.first(F.struct("hash", "before", "many", "context")).alias("c"))
        .join(times, "context_key")
        .where("size > 1 OR times > 1")
        .select("context_key", "c.*", "times", "size")
    )
    contexts = stored(contexts)
    small, large = F.col("size") <= LARGEST_BUCKET, F.col("size") > LARGEST_BUCKET
    blocks, distinct = _split(contexts.where(large), length, BLOCK)
    starts, strings = _split(distinct.where(large), length, 1)
    block_marks = _sorted(distinct.where(small), length).union(_whole(starts, _sorted(strings, length)))
    found = _sorted(contexts.where(small), length).union(_whole(blocks, block_marks))
    marks = (
        places.join(found, "context_key")
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("low", "stretches")).alias("marks"))
    )
    removed = part.select("text_key", "squeezed").join(marks, "text_key").mapInArrow(
        _remove(length),
        "text_key binary, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<int>",
    )
    per_text = counts.join(removed, "text_key", "left").where("copies > 1 OR n_removed IS NOT NULL")
    joined = rows.join(per_text, "text_key", "left")
    whole = F.col("copies") > 1
    nothing = F.sha2(F.lit(b""), 256)
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0), F.col("n_bytes").cast("int")))
        .otherwise(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed"),
    )


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
