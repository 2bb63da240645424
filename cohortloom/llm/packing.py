"""Best-fit packing by minimum bin slack.

Every document becomes token pieces of at most ``capacity``. The number of pieces of each length is
all that the packing needs: at most ``capacity`` counts, whatever the size of the corpus. Per bin,
a bitset subset-sum over the lengths that are left finds the fullest feasible combination around
the longest one; the combination is removed as often as the counts allow. The resulting patterns
are a table of a few thousand rows that gives each (length, number) its sequence and offset.
Pieces are numbered per length by partition counts, so no length is gathered in one task.

Null texts are empty texts: one piece with the end id. Repeated rows are packed each by itself.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import Recent, query, read, stored, text_of, text_pieces

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
BATCH_BYTES = 4_000_000
#: White space other than single spaces and line ends: such texts are encoded whole.
ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
TIED_SPACE = ("  ", "\n\n", " \n", "\n ")
#: Latin letters, then marks: two groups of their own in this kind of vocabulary.
GROUPS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*,.|?;:]*)")


def merge_ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Byte strings with their ids, and the special strings, of a byte-level BPE file.

    The ids serve as merge ranks; that they follow the merges is checked.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocab, merges = content["model"]["vocab"], content["model"]["merges"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = [t["content"] for t in content["added_tokens"]]
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if made != sorted(made) or (made and made[0] < 256):
        raise ValueError("ids do not follow the merges")
    return ranks, special


def token_bytes(path: str):
    """Function from a text to its ids as little-endian 32-bit numbers.

    Words between single spaces and lines are encoded apart from each other, which this kind of
    vocabulary does itself; words seen before are remembered. Groups of Latin letters and of marks
    are merged directly with the file's ranks. Everything else, and texts with other white space or
    special strings, goes through the file's own tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ranks, special = merge_ranks(path)
    core = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def group(data: bytes) -> bytes:
        return array("I", core.encode_single_piece(data)).tobytes()

    def word(text: str) -> bytes:
        found = GROUPS.fullmatch(text)
        if not found:
            return whole(" " + text)
        letters, marks = found.groups()
        return spaced[letters] + marked[marks] if marks else group(b" " + letters.encode())

    first = Recent(whole)
    spaced = Recent(word)
    marked = Recent(lambda marks: group(marks.encode()))
    newline = whole("\n")

    def line(text: str) -> bytes:
        head, *rest = text.split(" ")
        return first[head] + b"".join(map(spaced.__getitem__, rest)) if rest else first[head]

    def encode(text: str) -> bytes:
        if not text:
            return b""
        plain = (
            text[0] not in " \n" and text[-1] not in " \n"
            and not any(s in text for s in TIED_SPACE) and not any(c in text for c in ODD_SPACE)
            and not any(s in text for s in special)
        )
        return newline.join(map(line, text.split("\n"))) if plain else whole(text)

    return encode


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(path)
        end = np.array([end_id], "<u4").tobytes()
        numbers = np.zeros(capacity + 1, np.int64)
        part = None
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            part = batch.column("part")[0].as_py() if part is None else part
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            number = []
            for n in length:
                number.append(int(numbers[n]))
                numbers[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([part] * len(row), pa.int32()),
                    pa.array(number, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
            )

    return cut


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, numbered per length within their partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        "doc_id", text_of().alias("text"), F.spark_partition_id().alias("part")
    ).mapInArrow(
        _pieces(path, capacity, end_id),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "part int, number bigint",
    )


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """Largest total of at most ``room``: (length, times), by subset sums in one integer's bits.

    ``lengths`` fall; no length is used more often than its count. Longer ones are preferred.
    """
    full = (1 << (room + 1)) - 1
    reach = 1
    layers = []
    for length, count in zip(lengths, counts):
        if length > room:
            continue
        layers.append((length, min(count, room // length), reach))
        left, step = layers[-1][1], 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & full
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    chosen = []
    for length, most, before in reversed(layers):
        times = 0
        while not before >> target & 1:
            times += 1
            target -= length
            if times > most or target < 0:
                raise AssertionError("subset sums do not agree")
        if times:
            chosen.append((length, times))
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations with the number of bins filled by each, until no piece is left."""
    left = {n: c for n, c in counts.items() if c}
    found = []
    while left:
        order = sorted(left, reverse=True)
        seed = order[0]
        left[seed] -= 1
        rest = fullest(order, [left[n] for n in order], capacity - seed)
        left[seed] += 1
        use = dict(rest)
        use[seed] = use.get(seed, 0) + 1
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        found.append((sorted(use.items(), reverse=True), times))
    return found


def placements(found: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, ...]]:
    """(length, first number, last number + 1, times per bin, first bin, offset) of each use."""
    rows, used, bin_ = [], {}, 0
    for use, bins in found:
        offset = 0
        for length, times in use:
            first = used.get(length, 0)
            used[length] = first + times * bins
            rows.append((length, first, used[length], times, bin_, offset))
            offset += length * times
        bin_ += bins
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and place.

    Broadcast: the placement table. It has at most one row per length of each pattern, and a
    pattern exhausts a length, so it depends on ``capacity`` and not on the number of pieces.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path, capacity, end_id))
    per_part = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    totals = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = placements(patterns(totals, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select(
        "length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    place = spark.createDataFrame(
        rows, "p_length bigint, p_first bigint, p_end bigint, p_times bigint, p_bin bigint, p_offset bigint"
    )
    numbered = pieces.join(first, ["length", "part"]).withColumn(
        "rank", F.col("number") + F.col("before")
    )
    at = F.col("rank") - F.col("p_first")
    return numbered.join(
        F.broadcast(place),
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first"))
        & (F.col("rank") < F.col("p_end")),
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_bin") + F.floor(at / F.col("p_times"))).cast("bigint").alias("sequence_id"),
        (F.col("p_offset") + at % F.col("p_times") * F.col("length")).cast("bigint").alias("offset"),
    )


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
