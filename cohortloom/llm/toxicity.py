"""Toxicity by class-conditional Kneser-Ney models.

Two language models over the characters of words, one of toxic and one of ordinary text, give every
word a log-likelihood ratio. Each class has its own counts of the longest n-grams, of which a large discount
goes to what both classes share: one Kneser-Ney model with the counts of the longest n-grams and
continuation counts of shorter ones, gathered from all documents, labelled or not. So a rare
expression says little about its class. A document is judged by its length-normalised likelihood
ratio under the toxic model, under a model in which only some words are toxic, and by its most
telling words; a logistic link fitted on separate labelled rows turns these into a score.

Documents are stored in chunks, each as its distinct words. Every chunk counts its distinct n-grams, and these
counts add up to a stored table with one row per n-gram, under its letters themselves, so no two are ever
merged, however many there are. The lower orders are tables derived from that one, and order by order joins
give each n-gram its probability under what is shared and, for the longest, its ratio. Then every chunk lists its
n-grams by number, the listing meets the ratios, and these go back to their chunks and score the chunk's
words. N-grams that follow letters which no labelled text has are left out, as their ratio is 0. Nothing of the
size of the corpus or of its vocabulary is broadcast or collected.

Of the rows open for learning, those whose crc32 remainder is 1 fit the link (at most ``LINK_ROWS``
per class), the others are counted. Without toxic or ordinary rows every score is the share of
toxic labels (0.5 without labels). Null and empty texts have no words and get the link's value at 0.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import held_out, query, read, stored, text_of, text_pieces
from cohortloom.llm.quality import labelled_sample, logistic

TOP = 6
SHARED = (4, 2, 1)
DISCOUNT = 0.75
CLASS_DISCOUNT = 3.0
#: Share of toxic words in a toxic text.
SOME = 0.02
TELLING = 3
LINK_ROWS = 2000
#: Share of toxic rows that the link assumes, whatever the sample's.
PRIOR = 0.25
CHUNK_BYTES = 32_000_000
#: Training labels are broadcast up to so many, and joined beyond.
LABELLED_ROWS = 500_000
SALTS = 256
WORD = re.compile(r"[^\W_]+")
#: Neither occurs in a word.
START = "\2" * (TOP - 1)
END = "\1"
SIDES = ("every", "toxic", "ordinary")
FEATURES = ["y", "mean", "some", "dense", "telling"]
N_FEATURES = len(FEATURES) - 1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str) -> list[str]:
    """The longest n-gram that ends at each letter of the word, and at its end."""
    line = START + word + END
    return [line[at : at + TOP] for at in range(len(word) + 1)]


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some documents a row: ids, held-out marks, training labels, and distinct words compressed, a line each."""
    press = zstandard.ZstdCompressor(level=12)
    for batch in text_pieces(batches, "text", CHUNK_BYTES):
        lines = "\n".join(" ".join(sorted(set(words(t)))) for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([secrets.randbits(63)], pa.int64()),
                *(pa.ListArray.from_arrays([0, batch.num_rows], batch.column(c)) for c in ("doc_id", "held_out", "label")),
                pa.array([press.compress(lines.encode())], pa.binary()),
            ],
            ["chunk", "ids", "held", "labels", "squeezed"],
        )


def lines_of(squeezed: bytes) -> list[str]:
    """The documents of a chunk, each as a line of its distinct words."""
    return zstandard.ZstdDecompressor().decompress(squeezed).decode().split("\n")


class Grams:
    """All longest n-grams of some words, one word after another, as numbers in the order of their letters."""

    def __init__(self, listed: list[str]):
        line = "".join([f"{START}{word}{END}" for word in listed])
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        used = np.zeros(0x110000, bool)
        used[codes] = True
        self.letters = np.flatnonzero(used).astype(np.uint32)
        ids = (np.cumsum(used, dtype=np.int32) - 1)[codes]
        del line, codes, used
        #: n-grams per word
        self.sizes = np.fromiter(map(len, listed), np.int64, len(listed)) + 1
        ends = np.cumsum(self.sizes + TOP - 1)
        first = np.repeat(ends - np.cumsum(self.sizes) - (TOP - 1), self.sizes) + np.arange(int(self.sizes.sum()))
        size, half = max(len(self.letters), 1), TOP // 2

        def numbered(start: int, end: int) -> np.ndarray:
            found = np.zeros(len(first), np.int64)
            for i in range(start, end):
                found *= size
                found += ids[first + i]
            return found

        # all six letters fit one number for most alphabets, three for any
        self.halves = None
        if size**TOP < 2**62:
            self.keys = numbered(0, TOP)
        else:
            self.halves, codes = zip(*(np.unique(numbered(*p), return_inverse=True) for p in ((0, half), (half, TOP))))
            self.keys = codes[0].astype(np.int64) * len(self.halves[1]) + codes[1]

    def spelt(self, keys: np.ndarray) -> list[str]:
        size, half = max(len(self.letters), 1), TOP // 2
        if self.halves is None:
            parts = [keys // size**half, keys % size**half]
        else:
            many = len(self.halves[1])
            parts = [self.halves[0][keys // many], self.halves[1][keys % many]]
        digits = [p // size ** (half - 1 - i) % size for p in parts for i in range(half)]
        return np.ascontiguousarray(self.letters[np.stack(digits, 1)]).view(f"<U{TOP}").ravel().tolist() if len(keys) else []


class Listing:
    """A chunk's distinct words and n-grams, the latter sorted; ``places`` has each word's n-grams, one word after another."""

    def __init__(self, squeezed: bytes):
        lines = lines_of(squeezed)
        self.lengths = np.fromiter((line.count(" ") + 1 if line else 0 for line in lines), np.int64, len(lines))
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(map(str.split, lines))))}
        self.numbers = np.fromiter(
            map(number.__getitem__, chain.from_iterable(map(str.split, lines))), np.int32, int(self.lengths.sum())
        )
        found = Grams(list(number))
        self.sizes, self.spelt = found.sizes, found.spelt
        del number, lines
        self.keys, places = np.unique(found.keys, return_inverse=True)
        found.keys = None
        self.places = places.astype(np.int32)

    @property
    def grams(self) -> list[str]:
        return self.spelt(self.keys)

    def counts(self, taken: np.ndarray) -> np.ndarray:
        """How often the documents marked in ``taken`` have each n-gram."""
        words = np.bincount(self.numbers[np.repeat(taken, self.lengths)], minlength=len(self.sizes))
        return np.bincount(self.places, np.repeat(words, self.sizes), len(self.keys)).astype(np.int64)

    def word_ratios(self, ratios: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word, given those of the n-grams."""
        sums = np.append(0, np.cumsum(ratios[self.places], dtype=float))
        ends = np.cumsum(self.sizes)
        return sums[ends] - sums[ends - self.sizes]

    def features(self, ratios: np.ndarray) -> np.ndarray:
        return features(self.word_ratios(ratios)[self.numbers], self.lengths)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each chunk, and how many times texts of each side have their words."""
    for batch in batches:
        for labels, squeezed in zip(batch.column("labels").to_pylist(), batch.column("squeezed").to_pylist()):
            found = Listing(squeezed)
            label = np.array([-1 if y is None else y for y in labels])
            counts = [found.counts(taken) for taken in (np.ones(len(label), bool), label == 1, label == 0)]
            yield pa.RecordBatch.from_arrays([pa.array(found.grams, pa.string()), *map(pa.array, counts)], ["gram", *SIDES])


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each chunk and their places."""
    for batch in batches:
        for chunk, squeezed in zip(batch.column("chunk").to_pylist(), batch.column("squeezed").to_pylist()):
            # in the order of letters, as a chunk's listing has them, however its words are ordered
            found = Grams(list(dict.fromkeys(chain.from_iterable(map(str.split, lines_of(squeezed))))))
            listed = found.spelt(np.unique(found.keys))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(listed), chunk)), pa.array(np.arange(len(listed), dtype=np.int32)),
                    pa.array(listed, pa.string()),
                ],
                ["chunk", "place", "gram"],
            )


def features(ratios: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text, over its distinct words: mean ratio, the ratio if only some words are toxic
    (in sum and per root of the length), and the mean of the most telling words."""
    found = np.zeros((len(lengths), N_FEATURES))
    some = np.log1p(SOME * np.expm1(np.minimum(ratios, 12)))
    end = 0
    for i, length in enumerate(lengths.tolist()):
        start, end = end, end + length
        if length:
            own = ratios[start:end]
            top = np.partition(own, -TELLING)[-TELLING:] if length > TELLING else own
            summed = some[start:end].sum()
            found[i] = own.mean(), summed, summed / np.sqrt(length), top.sum() / TELLING
    return found


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def chunks_of(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """chunk, ids, held, labels, squeezed: some documents a row, stored, so that a chunk keeps its documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = (
        labels.where(F.col(label).isin(0, 1) & remainder().isin(2, 3, 4))
        .groupBy(F.col("doc_id").alias("of")).agg(F.max(label).cast("int").alias("label"))
        .withColumn("salt", F.lit(0))
    )
    if known.count() <= LABELLED_ROWS:
        known = F.broadcast(known)
    # rows without id, however many, meet no label in no single task
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS)) + 1).otherwise(0)
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    rows = rows.withColumn("dealt", salt).join(known, (F.col("doc_id") == F.col("of")) & (F.col("dealt") == F.col("salt")), "left")
    return stored(rows.select("doc_id", "held_out", "label", "text").mapInArrow(
        _chunk, f"chunk bigint, ids array<{kind}>, held array<boolean>, labels array<int>, squeezed binary"
    ))


def gram_counts(chunks: DataFrame) -> DataFrame:
    """gram, every, toxic, ordinary: one row per longest n-gram of the corpus; stored."""
    counts = chunks.select("labels", "squeezed").mapInArrow(
        _count_grams, "gram string, every bigint, toxic bigint, ordinary bigint"
    )
    return stored(counts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in SIDES)))


def shared_odds(grams: DataFrame) -> DataFrame:
    """ending, lower: how likely its last letter is after the others, for every ending of an n-gram, in all texts."""
    longer, tables = grams.select(F.col("gram").alias("key")), {}
    for order in SHARED:
        # an n-gram counts the different letters seen before it
        pairs = longer.select(F.substring("key", -order - 1, order + 1).alias("pair")).distinct()
        tables[order] = pairs.groupBy(F.substring("pair", 2, order).alias("key")).agg(F.count("*").alias("every"))
        longer = tables[order]
    found = None
    for order in reversed(SHARED):
        own = tables[order].withColumn("context", F.substring("key", 1, order - 1))
        given = own.groupBy("context").agg(
            F.sum("every").alias("total"), F.sum(F.least("every", F.lit(DISCOUNT))).alias("off")
        )
        rows = own.join(given, "context")
        if found is None:
            rows = rows.withColumn("lower", F.lit(1 / 65536))
        else:
            rows = rows.withColumn("ending", F.substring("key", -last, last)).join(found, "ending")
        odds = (F.greatest(F.col("every") - DISCOUNT, F.lit(0.0)) + F.col("off") * F.col("lower")) / F.col("total")
        found = rows.select(F.col("key").alias("ending"), F.greatest(odds, F.lit(1e-12)).alias("lower"))
        last = order
    return found


def gram_ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio: toxic minus ordinary log-likelihood of the last letter, of n-grams where it can differ from 0."""
    rates = {c: DISCOUNT if c == "every" else CLASS_DISCOUNT for c in SIDES}
    own = counts.withColumn("context", F.substring("gram", 1, TOP - 1))
    given = own.groupBy("context").agg(
        *(F.sum(c).alias(f"{c}_total") for c in SIDES),
        *(F.sum(F.least(F.col(c), F.lit(d))).alias(f"{c}_off") for c, d in rates.items()),
    ).where("toxic_total + ordinary_total > 0")
    rows = own.join(given, "context").withColumn("ending", F.substring("gram", -SHARED[0], SHARED[0]))
    rows = rows.join(shared_odds(counts), "ending")

    def mixed(side, lower):
        kept = F.greatest(F.col(side) - rates[side], F.lit(0.0)) + F.col(f"{side}_off") * lower
        return F.when(F.col(f"{side}_total") > 0, kept / F.col(f"{side}_total")).otherwise(lower)

    rows = rows.withColumn("shared", F.greatest(mixed("every", F.col("lower")), F.lit(1e-12)))
    ratio = F.log(mixed("toxic", F.col("shared"))) - F.log(mixed("ordinary", F.col("shared")))
    return rows.select("gram", ratio.cast("float").alias("ratio"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            listing = Listing(row.column("squeezed")[0].as_py())
            ratios = np.zeros(len(listing.keys), np.float32)
            given = row.column("ratios").flatten()
            if len(given):
                ratios[given.field("place").to_numpy()] = given.field("ratio").to_numpy()
            found = listing.features(ratios)
            yield pa.RecordBatch.from_arrays(
                [
                    row.column("ids").flatten(), row.column("held").flatten(),
                    *(pa.array(np.ascontiguousarray(c)) for c in found.T),
                ],
                ["doc_id", "held_out", *FEATURES[1:]],
            )


def document_features(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, held_out and the features of every row; stored, as the link is fitted on some of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunks_of(docs, labels, label)
    listing = chunks.select("chunk", "squeezed").mapInArrow(_list_grams, "chunk bigint, place int, gram string")
    back = (
        listing.join(gram_ratios(gram_counts(chunks)), "gram")
        .groupBy("chunk").agg(F.collect_list(F.struct("place", "ratio")).alias("ratios"))
    )
    numbers = ", ".join(f"{c} double" for c in FEATURES[1:])
    return stored(
        chunks.join(back, "chunk", "left").select("ids", "held", "squeezed", "ratios")
        .mapInArrow(_features, f"doc_id {kind}, held_out boolean, {numbers}")
    )


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    found = document_features(docs, labels, label)
    sample = spark.createDataFrame(
        labelled_sample(labels, label, LINK_ROWS, remainder() == 1).collect(),
        f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, y int",
    )
    rows = found.join(F.broadcast(sample), "doc_id").select(*FEATURES)
    rows = np.array(sorted(tuple(r) for r in rows.collect())).reshape(-1, 1 + N_FEATURES)
    y = rows[:, 0]
    if len(set(y.tolist())) < 2:
        score = F.lit(float(y.mean()) if len(y) else 0.5)
    else:
        share = y.mean()
        weight = np.where(y == 1, PRIOR / share, (1 - PRIOR) / (1 - share))
        link = logistic(rows[:, 1:], y, weight).tolist()
        z = sum((F.col(c) * w for c, w in zip(FEATURES[1:], link[1:])), F.lit(link[0]))
        score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))
    return found.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
