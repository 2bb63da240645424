"""Radial-kernel classifier: a landmark map in front of the linear machine.

A kernel machine needs all pairs of rows. The map (Nystroem) needs the similarity of each row to a bounded
number of landmark rows only: with K the landmarks' own similarities, ``k(x) K^-1/2`` is a vector whose inner
product with a landmark's vector is exactly their similarity, and near it for other rows. The linear machine
on these vectors is then trained by Spark as usual. Landmarks are the rows with the lowest draws among
distinct ones, so a row copied many times is at most one landmark; they and K are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators.sampling import draw
from cohortloom.sources.stored import StoredModel

LANDMARKS = 256
# directions of the landmarks' similarities weaker than this share of the strongest are left out
WEAKEST = 1e-12


def similarities(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(squares, 0))


class RadialMap(Estimator):
    """Estimator of the map from ``inputCol`` to ``outputCol``.

    ``gamma`` defaults to 1 / (places * variance of all numbers). Landmarks are drawn by ``idCol``, or by the
    vectors themselves. Fitting on no rows is an error.
    """

    def __init__(
        self, inputCol: str = "features", outputCol: str = "radial", landmarks: int = LANDMARKS,
        gamma: float | None = None, idCol: str | None = None, seed: int = fv.SEED,
    ):
        super().__init__()
        self.options = {k: v for k, v in locals().items() if k not in ("self", "__class__")}

    def _fit(self, dataset: DataFrame) -> RadialMapModel:
        o = self.options
        key = F.col(o["idCol"]) if o["idCol"] else F.xxhash64(o["inputCol"])
        rows = dataset.select(vector_to_array(o["inputCol"]).alias("x"), draw(key, o["seed"]).alias("chance"))
        chances = [r[0] for r in rows.select("chance").distinct().orderBy("chance").limit(o["landmarks"]).collect()]
        if not chances:
            raise ValueError("no rows to fit on")
        found = rows.filter(F.col("chance").isin(chances)).groupBy("chance").agg(F.min("x").alias("x")).collect()
        landmarks = np.array([r["x"] for r in sorted(found, key=lambda r: r["chance"])], float)
        gamma = o["gamma"]
        if gamma is None:
            total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
            squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
            size = landmarks.shape[1]
            mean, square = rows.agg(F.avg(total / size), F.avg(squares / size)).first()
            variance = square - mean**2
            gamma = 1 / (size * variance) if variance > 0 else 1.0
        return RadialMapModel(o["inputCol"], o["outputCol"], landmarks, gamma)


class RadialMapModel(StoredModel):
    """Landmarks in the order of their draws, and the map they define."""

    def __init__(self, input_col: str, output_col: str, landmarks: np.ndarray, gamma: float):
        super().__init__()
        self.input_col, self.output_col, self.landmarks, self.gamma = input_col, output_col, landmarks, float(gamma)
        values, directions = np.linalg.eigh(similarities(landmarks, landmarks, self.gamma))
        strong = values > WEAKEST * values[-1]
        self.root = directions[:, strong] / np.sqrt(values[strong])

    def state(self):
        settings = {"input_col": self.input_col, "output_col": self.output_col, "gamma": self.gamma}
        return settings, {"landmarks": self.landmarks}

    @classmethod
    def from_state(cls, settings, arrays):
        return cls(landmarks=arrays["landmarks"], **settings)

    def image(self, x: np.ndarray) -> np.ndarray:
        return similarities(x, self.landmarks, self.gamma) @ self.root

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shipped = dataset.sparkSession.sparkContext.broadcast((self.landmarks, self.gamma, self.root))

        @F.pandas_udf("array<double>")
        def mapped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            landmarks, gamma, root = shipped.value
            for part in parts:
                if len(part):
                    yield pd.Series(list(similarities(np.stack(part.to_numpy()), landmarks, gamma) @ root))
                else:
                    yield pd.Series([], dtype=object)

        return dataset.withColumn(self.output_col, array_to_vector(mapped(vector_to_array(self.input_col))))


class RadialSVM(Estimator):
    """Scaling, landmark map, linear machine of a given ``cost``, and a logistic fit on its margin.

    ``cost`` weighs the sum of the rows' losses against half the squared weights.
    """

    def __init__(
        self, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None, cost: float = 1.0,
        landmarks: int = LANDMARKS, gamma: float | None = None, idCol: str | None = None, maxIter: int = 100, seed: int = fv.SEED,
    ):
        super().__init__()
        self.options = {k: v for k, v in locals().items() if k not in ("self", "__class__")}

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        o = self.options
        scaler = StandardScaler(inputCol=o["featuresCol"], outputCol="_radial_scaled", withMean=True)
        rows = dataset.count()
        if not rows:
            raise ValueError("no rows to fit on")
        radial = RadialMap("_radial_scaled", "_radial", o["landmarks"], o["gamma"], o["idCol"], o["seed"])
        weight = {"weightCol": o["weightCol"]} if o["weightCol"] else {}
        stages = [
            scaler,
            radial,
            LinearSVC(
                featuresCol="_radial", labelCol=o["labelCol"], rawPredictionCol="_margin_raw", predictionCol="_margin_label",
                regParam=1 / (o["cost"] * rows), standardization=False, maxIter=o["maxIter"], **weight,
            ),
            VectorAssembler(inputCols=["_margin_raw"], outputCol="_margin"),
            LogisticRegression(featuresCol="_margin", labelCol=o["labelCol"], standardization=False),
        ]
        fitted = []
        for stage in stages:
            model = stage.fit(dataset) if isinstance(stage, Estimator) else stage
            dataset = model.transform(dataset)
            fitted.append(model)
        return PipelineModel(fitted)
