"""Network with two input branches, trained synchronously over partitions.

One branch reads the tabular places of a vector, the other the text-vector places; each is a stack of linear
layers with batch normalisation, rectifier and dropout. Their outputs are put side by side for a classifier of
one normalised and one plain layer. Rows are stored by step, so that a step reads its own rows only. It sends the
weights to their tasks, every task adds up the gradients of its rows, one task adds these sums, and the
driver moves the weights (Adam with weight decay). The driver gets one line of single-precision gradients a step,
whatever the number of tasks. After
each epoch the validation rows are scored in place; the rate is halved after ``patience // 2`` epochs without a better
ROC-AUC, training ends after ``patience``, and the best weights are kept.

Normalisation uses the mean and deviation of those rows of a step that come from one partition (at most an Arrow
batch) while training, and running averages of them when scoring. A step's rows go to tasks in pieces of about
``PIECE`` rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.base import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators.metrics import roc_auc
from cohortloom.operators.sampling import DRAW_LIMIT, draw
from cohortloom.session import ensure_checkpoint_dir
from cohortloom.sources.stored import StoredModel
from cohortloom.sources.tables import read_stage, write_stage

SMALL = 1e-5
MOMENTUM = 0.1
PIECE = 1024


class Layers:
    """A stack of linear layers; ``normal`` says which are normalised, all but a last plain one are rectified."""

    def __init__(self, sizes: Sequence[int], normal: Sequence[bool], name: str, last_plain: bool = False):
        self.sizes, self.normal, self.name, self.last_plain = list(sizes), list(normal), name, last_plain

    def start(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        weights = {}
        for i, (a, b) in enumerate(zip(self.sizes, self.sizes[1:])):
            bound = 1 / math.sqrt(max(a, 1))
            weights[f"{self.name}.w{i}"] = rng.uniform(-bound, bound, (a, b))
            weights[f"{self.name}.b{i}"] = rng.uniform(-bound, bound, b)
            if self.normal[i]:
                weights[f"{self.name}.scale{i}"], weights[f"{self.name}.shift{i}"] = np.ones(b), np.zeros(b)
        return weights

    def forward(self, weights, x, running=None, masks=None):
        """Outputs, what the way back needs, and batch statistics; ``running``: scoring with running averages."""
        kept, stats = [], {}
        for i in range(len(self.sizes) - 1):
            n = self.name
            z = x @ weights[f"{n}.w{i}"] + weights[f"{n}.b{i}"]
            plain, hat, spread = z, None, None
            if self.normal[i]:
                if running is None:
                    mean, var = z.mean(0), z.var(0)
                    stats[f"{n}.mean{i}"], stats[f"{n}.var{i}"] = mean, var * len(z) / max(len(z) - 1, 1)
                else:
                    mean, var = running[f"{n}.mean{i}"], running[f"{n}.var{i}"]
                spread = np.sqrt(var + SMALL)
                hat = (z - mean) / spread
                plain = hat * weights[f"{n}.scale{i}"] + weights[f"{n}.shift{i}"]
            if self.last_plain and i == len(self.sizes) - 2:
                out, mask = plain, None
            else:
                mask = None if masks is None else masks[f"{n}.{i}"]
                out = np.maximum(plain, 0) * (1 if mask is None else mask)
            kept.append((x, plain, hat, spread, mask, out is plain))
            x = out
        return x, kept, stats

    def backward(self, weights, kept, slope):
        found = {}
        for i in range(len(kept) - 1, -1, -1):
            n = self.name
            x, plain, hat, spread, mask, is_plain = kept[i]
            if not is_plain:
                slope = slope * (plain > 0) * (1 if mask is None else mask)
            if hat is not None:
                found[f"{n}.scale{i}"], found[f"{n}.shift{i}"] = (slope * hat).sum(0), slope.sum(0)
                inner = slope * weights[f"{n}.scale{i}"]
                slope = (inner - inner.mean(0) - hat * (inner * hat).mean(0)) / spread
            found[f"{n}.w{i}"], found[f"{n}.b{i}"] = x.T @ slope, slope.sum(0)
            slope = slope @ weights[f"{n}.w{i}"].T
        return found, slope


class Network:
    """Two branches and a classifier over rows whose first ``left`` numbers belong to the first branch."""

    def __init__(self, left: int, right: int, towers=((32, 64), (64, 64)), combined: int = 128, last: int = 64, dropout: float = 0.3):
        self.left, self.right, self.dropout = left, right, dropout
        self.shape = {"left": left, "right": right, "towers": towers, "combined": combined, "last": last, "dropout": dropout}
        self.parts = [
            Layers([size, *tower], [True] * len(tower), name)
            for size, tower, name in ((left, towers[0], "left"), (right, towers[1], "right")) if size
        ]
        joined = sum(p.sizes[-1] for p in self.parts)
        self.top = Layers([joined, combined, last, 1], [True, False, False], "top", last_plain=True)

    def start(self, seed: int):
        rng = np.random.default_rng(seed)
        weights = {}
        for part in (*self.parts, self.top):
            weights.update(part.start(rng))
        running = {}
        for part in (*self.parts, self.top):
            for i, normal in enumerate(part.normal):
                if normal:
                    running[f"{part.name}.mean{i}"], running[f"{part.name}.var{i}"] = np.zeros(part.sizes[i + 1]), np.ones(part.sizes[i + 1])
        return weights, running

    def masks(self, rows: int, rng: np.random.Generator):
        if not self.dropout:
            return None
        return {
            f"{p.name}.{i}": (rng.random((rows, b)) >= self.dropout) / (1 - self.dropout)
            for p in (*self.parts, self.top) for i, b in enumerate(p.sizes[1:])
        }

    def _inputs(self, x):
        return {"left": x[:, : self.left], "right": x[:, self.left :]}

    def margins(self, weights, running, x):
        inputs = self._inputs(x)
        outs = [p.forward(weights, inputs[p.name], running)[0] for p in self.parts]
        return self.top.forward(weights, np.hstack(outs), running)[0][:, 0]

    def slopes(self, weights, x, y, masks=None):
        """Summed loss, its gradients and the batch's statistics."""
        inputs = self._inputs(x)
        passed = [p.forward(weights, inputs[p.name], None, masks) for p in self.parts]
        z, kept, stats = self.top.forward(weights, np.hstack([o for o, _, _ in passed]), None, masks)
        z = z[:, 0]
        for _, _, more in passed:
            stats.update(more)
        loss = (np.logaddexp(0, z) - y * z).sum()
        found, slope = self.top.backward(weights, kept, (1 / (1 + np.exp(-z)) - y)[:, None])
        at = 0
        for part, (out, own, _) in zip(self.parts, passed):
            more, _ = part.backward(weights, own, slope[:, at : at + out.shape[1]])
            found.update(more)
            at += out.shape[1]
        return loss, found, stats


def flat(values: dict[str, np.ndarray], names: Sequence[str]) -> np.ndarray:
    return np.concatenate([np.asarray(values[n], float).ravel() for n in names]) if names else np.zeros(0)


def unflat(line: np.ndarray, like: dict[str, np.ndarray], names: Sequence[str]) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for n in names:
        found[n] = line[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return found


def _step(shared, names, stat_names, seed: int):
    """One row per task: its rows, loss, and sums of gradients and of weighted statistics."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, weights = shared.value
        total, rows = None, 0
        for batch in _by_place(batches):
            if batch.num_rows < 2:  # no deviation in a single row
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            rng = np.random.default_rng((seed, batch.num_rows, int(abs(x).sum() * 1e6) % 2**32))
            loss, found, stats = network.slopes(weights, x, y, network.masks(len(x), rng))
            line = np.concatenate([[len(x), loss], flat(found, names), len(x) * flat(stats, stat_names)])
            total = line if total is None else total + line
            rows += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["line"])

    return step


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all lines, in single precision for the way to the driver."""
    total = None
    for batch in batches:
        for line in batch.column("line").to_pylist():
            line = np.frombuffer(line)
            total = line if total is None else total + line
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["line"])


def stored_steps(rows: DataFrame, batch: int) -> DataFrame:
    """Rows (x, y, step) stored in a folder per step with their ``place``, the partition they come from.

    The rows of a step lie in a file per piece, in the order they had; equal rows share a step, but not a piece.
    """
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/steps-{uuid.uuid4().hex}"
    placed = rows.select("x", "y", "step", F.spark_partition_id().alias("place"), F.monotonically_increasing_id().alias("row"))
    piece = F.when(F.col("step") < 0, F.col("place")).otherwise(F.col("place") % max(1, round(batch / PIECE)))
    dealt = placed.withColumn("piece", piece).repartition("step", "piece").sortWithinPartitions("step", "row")
    write_stage(dealt.select("x", "y", "step", "place"), path, ["step"])
    return read_stage(rows.sparkSession, path)


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the place changes."""
    for batch in batches:
        places = batch.column("place").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


class TwoTowers(Estimator):
    """Estimator over a vector whose first ``left`` places are tabular: ``probability`` and ``prediction``."""

    def __init__(
        self, featuresCol: str = "features", labelCol: str = "label", left: int = 0, batchSize: int = 1024,
        held: float = 0.15, seed: int = fv.SEED, **params,
    ):
        super().__init__()
        given = {"featuresCol": featuresCol, "labelCol": labelCol, "left": left, "batchSize": batchSize, "held": held, "seed": seed}
        self.options = {**fv.NETWORK_PARAMS, **given, **params}

    def _fit(self, dataset: DataFrame) -> TwoTowerModel:
        o = self.options
        spark = dataset.sparkSession
        key = F.xxhash64(o["featuresCol"]).cast("string")
        chance = draw(key, o["seed"]) / F.lit(float(DRAW_LIMIT))
        rows = dataset.select(
            vector_to_array(o["featuresCol"]).alias("x"), F.col(o["labelCol"]).cast("double").alias("y"), chance.alias("chance")
        )
        count, size = rows.agg(F.count_if(F.col("chance") >= o["held"]), F.max(F.size("x"))).first()
        network = Network(o["left"], max((size or 0) - o["left"], 0), o["towers"], o["combined"], o["last"], o["dropout"])
        weights, running = network.start(o["seed"])
        model = TwoTowerModel(o["featuresCol"], network, weights, running)
        if not count:
            return model
        steps = max(1, round(count / o["batchSize"]))
        # -1: held out for the early stop; held rows and batches are drawn, so they are even in every partition
        number = F.floor((F.col("chance") - o["held"]) / (1 - o["held"]) * steps)
        step = F.when(F.col("chance") < o["held"], -1).otherwise(F.least(number, F.lit(steps - 1))).cast("int")
        rows = stored_steps(rows.select("x", "y", step.alias("step")), o["batchSize"])
        names, stat_names = sorted(weights), sorted(running)
        first, second = np.zeros(flat(weights, names).size), np.zeros(flat(weights, names).size)
        rate, moved, best, since = o["stepSize"], 0, -1.0, 0
        for epoch in range(o["epochs"]):
            for step in np.random.default_rng((o["seed"], epoch)).permutation(steps).tolist():
                shared = spark.sparkContext.broadcast((network, weights))
                parts = rows.where(F.col("step") == step).select("x", "y", "place").mapInArrow(
                    _step(shared, names, stat_names, o["seed"] + moved), "line binary"
                )
                # collect, as a limit would end the Python worker of the sum before its stream does
                found = parts.repartition(1).mapInArrow(_add, "line binary").collect()
                shared.destroy()
                if not found:
                    continue
                line = np.frombuffer(found[0]["line"], np.float32).astype(float)
                moved += 1
                slope = line[2 : 2 + len(first)] / line[0] + o["decay"] * flat(weights, names)
                means = unflat(line[2 + len(first) :] / line[0], running, stat_names)
                running = {n: (1 - MOMENTUM) * running[n] + MOMENTUM * means[n] for n in stat_names}
                first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
                push = first / (1 - 0.9**moved) / (np.sqrt(second / (1 - 0.999**moved)) + 1e-8)
                weights = unflat(flat(weights, names) - rate * push, weights, names)
            tried = TwoTowerModel("x", network, weights, running)
            held = rows.where("step = -1")
            area = roc_auc(tried.scored(held), "y", "score").first()[0]
            if area is not None and area > best:
                best, since = area, 0
                model = TwoTowerModel(o["featuresCol"], network, weights, running, best)
            else:
                since += 1
                if since % max(o["patience"] // 2, 1) == 0:
                    rate /= 2
                if since >= o["patience"]:
                    break
        return model


class TwoTowerModel(StoredModel):
    """Trained weights with their running averages; ``area`` is the ROC-AUC of the held rows."""

    def __init__(self, features: str, network: Network, weights: dict, running: dict, area: float | None = None):
        super().__init__()
        self.features, self.network, self.weights, self.running, self.area = features, network, weights, running, area

    def state(self):
        settings = {"features": self.features, "area": self.area, "network": self.network.shape}
        weights = {f"weights/{n}": v for n, v in self.weights.items()}
        return settings, {**weights, **{f"running/{n}": v for n, v in self.running.items()}}

    @classmethod
    def from_state(cls, settings, arrays):
        parts = {"weights": {}, "running": {}}
        for name, values in arrays.items():
            part, _, name = name.partition("/")
            parts[part][name] = values
        return cls(settings["features"], Network(**settings["network"]), area=settings["area"], **parts)

    def _score(self, spark):
        shared = spark.sparkContext.broadcast((self.network, self.weights, self.running))

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            network, weights, running = shared.value
            for part in parts:
                x = np.stack(part.to_numpy()) if len(part) else np.zeros((0, network.left + network.right))
                yield pd.Series(1 / (1 + np.exp(-network.margins(weights, running, x))))

        return score

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows with an array column ``x`` and their ``score``."""
        return rows.select("*", self._score(rows.sparkSession)("x").alias("score"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = F.col("_score")
        return (
            dataset.withColumn("_score", self._score(dataset.sparkSession)(vector_to_array(self.features)))
            .withColumn("probability", array_to_vector(F.array(1 - p, p)))
            .withColumn("prediction", (p >= 0.5).cast("double")).drop("_score")
        )
