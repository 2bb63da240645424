"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its runs of five words (all its words if it has fewer). Documents with
equal sets are copies and go on as one. MinHash bands bring similar sets into common buckets; the
buckets' members are linked to their smallest members only, and the connected groups that result are the
candidate groups. Within a group, pairs are compared MinHash by MinHash: after every ``STEP``
values a pair is dropped when the posterior probability that its similarity reaches the threshold
is below ``TOLERANCE``; what is left is verified on the sets themselves. Pairs are never emitted:
a task reports links per document and one star per group that it joins.

Groups over the block size are compared block against block, so no task holds a whole group.
A pair at the threshold shares no band with probability (1 - 0.8**5)**40, about 1e-7.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Null texts and texts
without words have no set: they are linked to nothing. Repeated rows are copies. Null ids are
carried; a class is named by its smallest id, nulls last.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import (
    Recent,
    components,
    query,
    read,
    runs,
    stored,
    text_key,
    text_of,
    text_pieces,
    words_of,
)

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
STEP = 20
TOLERANCE = 1e-9
BATCH_BYTES = 4_000_000
SMALLEST_BLOCK, LARGEST_BLOCK, BLOCKS_PER_GROUP = 128, 2048, 16


class Shingler:
    def __init__(self, size: int = SHINGLE, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size = size
        self.known = Recent(lambda w: xxhash.xxh64_intdigest(w), 300_000)
        self.factors = rng.integers(1, 2**63, size, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.times = rng.integers(1, 2**31, HASHES, dtype=np.int64).astype(np.uint32) | np.uint32(1)
        self.plus = rng.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct runs of words."""
        words = words_of(text)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        count = max(1, len(words) - self.size + 1) if words else 0
        total = np.zeros(count, np.uint64)
        for k, factor in enumerate(self.factors[: len(words)]):
            total += hashes[k : k + count] * factor
        total ^= total >> np.uint64(31)
        return np.unique(total * np.uint64(0xBF58476D1CE4E5B9))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """MinHash values."""
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        found = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(low), 4096):
            mixed = low[None, start : start + 4096] * self.times[:, None] + self.plus[:, None]
            found = np.minimum(found, mixed.min(1))
        return found


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key of each document's set and its band keys; nulls for documents without words."""
    shingler = Shingler()
    for batch in text_pieces(batches, "text", BATCH_BYTES):
        keys, bands = [], []
        for text in batch.column("text").to_pylist():
            shingles = shingler.shingles(text)
            if not len(shingles):
                keys.append(None)
                bands.append(None)
                continue
            keys.append(set_key(shingles))
            rows = shingler.signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
            mixed = np.zeros(BANDS, np.uint64)
            for column in rows.T:
                mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            bands.append(mixed.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text_key"),
                pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ],
            ["doc_id", "text_key", "set_key", "bands"],
        )


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and MinHash values of the documents that have candidates."""
    shingler = Shingler()
    for batch in text_pieces(batches, "text", BATCH_BYTES):
        sets = [shingler.shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("set_key", "group", "size", "copies")),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([shingler.signature(s).tobytes() for s in sets], pa.binary()),
            ],
            ["set_key", "group", "size", "copies", "shingles", "signature"],
        )


def least_matches(threshold: float, tolerance: float, step: int, hashes: int) -> list[tuple[int, int]]:
    """(values compared, matches needed): below, the posterior of reaching the threshold is too small.

    With a uniform prior, P(J >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    needed = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        needed.append((n, m))
    return needed


class Block:
    """Rows of one side of a comparison."""

    def __init__(self, table: pa.Table):
        self.keys = table.column("set_key").to_pylist()
        self.copies = table.column("copies").to_numpy()
        self.sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        self.signatures = np.array(
            [np.frombuffer(s, np.uint32) for s in table.column("signature").to_pylist()]
        )

    def __len__(self) -> int:
        return len(self.keys)


def survivors(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]], upper: bool):
    """Pairs that the posterior never rules out, as two index arrays."""
    n, m = needed[0]
    found_a, found_b, found_n = [], [], []
    rows = max(1, 4_000_000 // (n * max(1, len(right))))
    for start in range(0, len(left), rows):
        same = (left[start : start + rows, None, :n] == right[None, :, :n]).sum(2)
        keep = same >= m
        if upper:
            keep &= np.arange(len(right))[None, :] > np.arange(start, start + len(same))[:, None]
        a, b = np.nonzero(keep)
        found_a.append(a + start)
        found_b.append(b)
        found_n.append(same[a, b])
    a, b, same = (np.concatenate(x) for x in (found_a, found_b, found_n))
    before = n
    for n, m in needed[1:]:
        fresh = np.empty(len(a), np.int64)
        for start in range(0, len(a), 100_000):
            part = slice(start, start + 100_000)
            fresh[part] = (left[a[part], before:n] == right[b[part], before:n]).sum(1)
        same = same + fresh
        keep = same >= m
        a, b, same = a[keep], b[keep], same[keep]
        before = n
    return a, b


def verified(left: Block, right: Block, a: np.ndarray, b: np.ndarray, threshold: Fraction):
    """The pairs whose sets reach the threshold, by exact set sizes."""
    flat = np.concatenate([*left.sets, *right.sets])
    vocabulary, ids = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in [*left.sets, *right.sets]])
    edges = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(vocabulary), np.int64)
    keep = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    starts = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]]) if len(a) else np.array([], int)
    offset = len(left)
    for first, end in zip(starts, np.r_[starts[1:], len(a)]):
        pairs = order[first:end]
        row = a[pairs[0]]
        own = ids[edges[row] : edges[row + 1]]
        mark[own] = 1
        for pair in pairs.tolist():
            other = offset + b[pair]
            common = int(mark[ids[edges[other] : edges[other + 1]]].sum())
            union = int(sizes[row] + sizes[other]) - common
            keep[pair] = common * threshold.denominator >= threshold.numerator * union
        mark[own] = 0
    return a[keep], b[keep]


def _stars(keys: list[bytes], a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Each linked key with the smallest key that links join it to."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    place = {i: k for k, i in enumerate(order)}
    parent = list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, j in zip(a.tolist(), b.tolist()):
        first, second = sorted((root(place[i]), root(place[j])))
        parent[second] = first
    return [(keys[order[k]], keys[order[root(k)]]) for k in range(len(keys)) if root(k) != k]


def _compare(threshold: float):
    exact = Fraction(str(threshold))
    needed = least_matches(threshold, TOLERANCE, STEP, HASHES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document its links (texts, documents) in this comparison; stars that join them."""
        for table in runs(batches, ["group", "i", "j"]):
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            own = table.column("own").to_numpy()
            if i == j:
                left = right = Block(table)
            else:
                left = Block(table.filter(pa.array(own == i)))
                right = Block(table.filter(pa.array(own == j)))
            if not len(left) or not len(right):
                continue
            a, b = survivors(left.signatures, right.signatures, needed, i == j)
            a, b = verified(left, right, a, b, exact)
            if not len(a):
                continue
            base = 0 if i == j else len(left)
            keys = left.keys if i == j else left.keys + right.keys
            copies = left.copies if i == j else np.r_[left.copies, right.copies]
            b = b + base
            texts = np.bincount(a, minlength=len(keys)) + np.bincount(b, minlength=len(keys))
            docs = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
            links = _stars(keys, a, b)
            at = np.flatnonzero(texts).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[x] for x in at] + [x for x, _ in links], pa.binary()),
                    pa.array([None] * len(at) + [y for _, y in links], pa.binary()),
                    pa.array([int(texts[x]) for x in at] + [0] * len(links), pa.int64()),
                    pa.array([int(docs[x]) for x in at] + [0] * len(links), pa.int64()),
                ],
                ["set_key", "other", "n_texts", "n_links"],
            )

    return compare


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, text_key, class_id, class_key, n_links, n_texts, n_copies.

    ``n_links`` counts the other documents with similarity of at least ``threshold``, ``n_texts``
    the linked sets that differ from the row's own, ``n_copies`` the rows with the same set.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"), text_key().alias("text_key"))
    sketches = stored(
        texts.mapInArrow(
            _sketch, f"doc_id {kind}, text_key binary, set_key binary, bands array<bigint>"
        )
    )
    found = sketches.where("set_key IS NOT NULL")
    sets = found.groupBy("set_key").agg(
        F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "bands")).alias("first"),
    )
    sets = stored(
        sets.select("set_key", "copies", "first.doc_id", "first.text_key", "first.bands")
    )
    members = sets.select("set_key", F.posexplode("bands").alias("band", "value"))
    buckets = members.groupBy("band", "value").agg(F.min("set_key").alias("low"), F.count("*").alias("n"))
    # per set: its buckets' smallest members, at most one per band; all belong to one group, so
    # linking them to the smallest of them is enough and leaves few different links
    lows = (
        members.join(buckets.where("n > 1"), ["band", "value"])
        .groupBy("set_key").agg(F.collect_set("low").alias("lows"))
        .withColumn("least", F.array_min("lows"))
    )
    star = (
        lows.select(
            F.explode(F.array_union(F.array("set_key"), "lows")).alias("a"), F.col("least").alias("b")
        )
        .where("a <> b").distinct()
    )
    groups = components(star)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    candidates = (
        sets.select("set_key", "copies", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .join(groups.join(sizes, "root").select(F.col("node").alias("set_key"), F.col("root").alias("group"), "size"), "set_key")
    )
    rows = texts.join(
        candidates, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    ).dropDuplicates(["doc_id", "text_key"])
    payload = rows.select("text", "set_key", "group", "size", "copies").mapInArrow(
        _payload,
        "set_key binary, group binary, size bigint, copies bigint, shingles binary, signature binary",
    )
    width = F.least(
        F.lit(LARGEST_BLOCK),
        F.greatest(F.lit(SMALLEST_BLOCK), F.ceil(F.col("size") / BLOCKS_PER_GROUP)),
    )
    blocks = F.ceil(F.col("size") / width).cast("int")
    own = F.pmod(F.xxhash64("set_key"), blocks).cast("int")
    dealt = (
        payload.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .drop("size", "other")
    )
    compared = stored(
        dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(
            _compare(threshold), "set_key binary, other binary, n_texts bigint, n_links bigint"
        )
    )
    links = compared.groupBy("set_key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("n_links"))
    edges = compared.where("other IS NOT NULL").select(F.col("set_key").alias("a"), F.col("other").alias("b"))
    classes = components(edges).withColumnRenamed("node", "set_key")
    linked = classes.join(links, "set_key")
    named = (
        sets.select("set_key", "copies", "doc_id").join(linked, "set_key", "left")
        .withColumn("class_key", F.coalesce("root", "set_key"))
    )
    class_ids = named.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    per_set = stored(
        named.join(class_ids, "class_key").select(
            "set_key", "class_key", "class_id", "copies",
            F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
            (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return sketches.select("doc_id", "text_key", "set_key").join(per_set, "set_key", "left").select(
        "doc_id", "text_key", "set_key", "class_key",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the smallest id; rows without words all stay."""
    found = similar_documents(docs, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    kept = found.where("class_key IS NOT NULL").groupBy("class_key").agg(first.alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    alone = (
        found.where("class_key IS NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
        .select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    )
    kept = kept.withColumn("once", F.lit(True)).union(alone.withColumn("once", F.lit(False)))
    # the document's own columns stay in one struct, so their names cannot clash
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_key().alias("key")
    ).join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    # repeated rows share id and text; the join has brought them into one partition
    tie = F.row_number().over(Window.partitionBy("kept_id", "kept_key").orderBy(F.lit(1)))
    return rows.withColumn("tie", tie).where("tie = 1 OR NOT once").select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT r, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM g),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
k AS (SELECT a, min(doc_id) AS low FROM t JOIN w ON r = b GROUP BY a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, coalesce(least(doc_id, low), doc_id) AS class_id, coalesce(l.n, 0) AS n_links
FROM w LEFT JOIN k ON k.a = r LEFT JOIN l ON l.a = r"""


@query("op7_ngram_jaccard_join", SQL)
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
