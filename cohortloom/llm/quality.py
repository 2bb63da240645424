"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes become small
learned vectors, learned filters slide over them, each filter keeps its largest answer within the
chunk (max-pooling), and a linear layer turns these into the chunk's logit. The mean and the lowest
chunk logit of a document are combined into one probability.

The network is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` rows of each class,
in the order of a hash of the id, each by ``CHUNKS_PER_ROW`` evenly spaced chunks and one short
beginning, so that short texts are known, too. Everything else covers all rows and whole texts. With no labels, or only one class, every score is the share of
label 1 (0.5 without labels). Null texts are empty texts; they get a score like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import held_out, query, read, text_of, text_pieces

SAMPLE = 1000
CHUNKS_PER_ROW = 6
BEGINNINGS = (12, 24, 48, 96, 192)
CHUNK, STEP = 512, 448
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 2, 24
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
PAD = 256
EPOCHS = 8
BATCH = 128
KEEP_FROM = 0.3
BATCH_BYTES = 2_000_000


def chunk_starts(size: int) -> np.ndarray:
    """Starts of overlapping chunks that cover ``size`` bytes; one for an empty text."""
    return np.arange(0, max(1, size - (CHUNK - STEP)), STEP)


def chunks_of(data: bytes, starts: np.ndarray) -> np.ndarray:
    padded = np.full(int(starts[-1]) + CHUNK, PAD, np.int16)
    whole = np.frombuffer(data, np.uint8)[: len(padded)]
    padded[: len(whole)] = whole
    return padded[starts[:, None] + np.arange(CHUNK)]


class Network:
    """Embedding, one convolution, max-pooling and a linear layer, with Adam."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = {
            "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)),
            "filters": rng.normal(0, 1 / np.sqrt(EMBED * WIDTH), (EMBED * WIDTH, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 1 / np.sqrt(FILTERS), FILTERS),
            "shift": np.zeros(1),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        #: doc-level combination: intercept, weight of the mean logit, of the lowest logit
        self.combine = np.array([0.0, 1.0, 0.0])
        self.prior: float | None = None

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        vectors = self.weights["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(vectors, EMBED * WIDTH, axis=1)
        return view[:, :: EMBED * STRIDE]

    def _pooled(self, chunks: np.ndarray):
        windows = self._windows(chunks)
        answers = windows.reshape(-1, EMBED * WIDTH) @ self.weights["filters"]
        answers = answers.reshape(len(chunks), POSITIONS, FILTERS)
        return windows, answers

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        result = np.empty(len(chunks))
        for start in range(0, len(chunks), BATCH):
            _, answers = self._pooled(chunks[start : start + BATCH])
            pooled = np.maximum(answers.max(1) + self.weights["bias"], 0)
            result[start : start + BATCH] = pooled @ self.weights["out"] + self.weights["shift"][0]
        return result

    def fit(self, chunks: np.ndarray, labels: np.ndarray, weight: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * 0.7**epoch
            for rows in np.array_split(rng.permutation(len(chunks)), max(1, len(chunks) // BATCH)):
                step += 1
                for name, slope in self._slopes(chunks[rows], labels[rows], weight[rows]).items():
                    first[name] = 0.9 * first[name] + 0.1 * slope
                    second[name] = 0.999 * second[name] + 0.001 * slope**2
                    move = first[name] / (1 - 0.9**step)
                    scale = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                    self.weights[name] -= (rate * move / scale).astype(np.float32)

    def _slopes(self, chunks: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
        windows, answers = self._pooled(chunks)
        best = answers.argmax(1)
        rows = np.arange(len(chunks))[:, None]
        raw = np.take_along_axis(answers, best[:, None, :], 1)[:, 0] + self.weights["bias"]
        pooled = np.maximum(raw, 0)
        logit = pooled @ self.weights["out"] + self.weights["shift"][0]
        error = ((1 / (1 + np.exp(-logit)) - labels) * weight / len(chunks)).astype(np.float32)
        back = np.where(raw > 0, error[:, None] * self.weights["out"], 0).astype(np.float32)
        chosen = windows[rows, best]  # chunk, filter, window
        filters = np.einsum("cf,cfw->wf", back, chosen)
        into = (back[:, :, None] * self.weights["filters"].T[None]).reshape(-1, EMBED)
        places = best[:, :, None] * STRIDE + np.arange(WIDTH)
        embed = np.zeros_like(self.weights["embed"])
        np.add.at(embed, chunks[rows[:, :, None], places].reshape(-1), into)
        return {
            "embed": embed, "filters": filters, "bias": back.sum(0),
            "out": pooled.T @ error, "shift": np.array([error.sum()]),
        }

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean and lowest chunk logit of each text."""
        starts = [chunk_starts(len(t)) for t in texts]
        found = np.empty((len(texts), 2))
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(starts[end]) <= 2048):
                held += len(starts[end])
                end += 1
            sizes = np.array([len(s) for s in starts[at:end]])
            if end == at + 1 and held > 2048:  # one very long text, part by part
                parts = [self.logits(chunks_of(texts[at][s[0] :], s - s[0])) for s in np.array_split(starts[at], held // 2048 + 1)]
                logits = np.concatenate(parts)
            else:
                logits = self.logits(np.concatenate([chunks_of(t, s) for t, s in zip(texts[at:end], starts[at:end])]))
            edges = np.r_[0, np.cumsum(sizes)[:-1]]
            found[at:end, 0] = np.add.reduceat(logits, edges) / sizes
            found[at:end, 1] = np.minimum.reduceat(logits, edges)
            at = end
        return found

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        found = self.features(texts)
        z = self.combine[0] + found @ self.combine[1:]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def logistic(features: np.ndarray, labels: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and weights by Newton steps, each row with its ``weight``."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def labelled_sample(labels: DataFrame, label: str, per_class: int, usable: Column) -> DataFrame:
    """(doc_id, y) of at most ``per_class`` labelled ids of each class, by a hash of the id."""
    known = (
        labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    parts = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for y in (0, 1)
    ]
    return parts[0].union(parts[1])


def sampled_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts of the sampled ids. Broadcast: two times ``per_class`` ids."""
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")


def _sample_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evenly spaced chunks of each row, the first and the last among them, and a short beginning."""
    for batch in text_pieces(batches, "text", BATCH_BYTES):
        found = []
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode()
            short = data[: BEGINNINGS[zlib.crc32(str(name).encode()) // 5 % len(BEGINNINGS)]]
            starts = chunk_starts(len(data))
            picked = starts[np.unique(np.linspace(0, len(starts) - 1, CHUNKS_PER_ROW).astype(int))]
            parts = [short, *(data[s:] for s in picked.tolist())]
            found.append(b"".join(chunks_of(p, np.array([0])).tobytes() for p in parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "chunks"]
        )


def _features_with(shared):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            found = shared.value.features([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), *(pa.array(c) for c in found.T)], ["y", "mean", "lowest"]
            )

    return compute


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> Network:
    """Driver: the sample's chunks, ``2 x per_class x (CHUNKS_PER_ROW + 1) x CHUNK`` numbers at most."""
    spark = docs.sparkSession
    sample = spark.createDataFrame(
        labelled_sample(labels, label, per_class, ~held_out()).collect(),
        f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, y int",
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sampled_rows(docs, sample).mapInArrow(_sample_chunks, f"doc_id {kind}, y int, chunks binary")
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["chunks"]))
    network = Network()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        network.prior = float(y.mean()) if len(y) else 0.5
        return network
    chunks = [np.frombuffer(r["chunks"], np.int16).reshape(-1, CHUNK) for r in rows]
    sizes = np.array([len(c) for c in chunks])
    owner = np.repeat(np.arange(len(rows)), sizes)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = (balance / sizes)[owner] * len(owner) / len(rows)
    network.fit(np.concatenate(chunks), y[owner].astype(np.float32), weight.astype(np.float32))
    shared = spark.sparkContext.broadcast(network)
    found = sampled_rows(docs, sample).mapInArrow(
        _features_with(shared), "y int, mean double, lowest double"
    ).collect()
    found = np.array(sorted(tuple(r) for r in found))
    network.combine = logistic(found[:, 1:], found[:, 0])
    return network


def _scorer(shared, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            scores = network.scores([t.encode() for t in batch.column("text").to_pylist()])
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                [*names, "score", "predicted"],
            )

    return score


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = KEEP_FROM
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; no shuffle of the texts."""
    network = train(docs, labels, label)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(
        _scorer(shared, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM) -> DataFrame:
    """Rows that the classifier accepts, with all their columns; scored and dropped in one pass."""
    network = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            scores = network.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
