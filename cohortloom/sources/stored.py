"""Fitted stages written in Python: saved and loaded like any other stage of a pipeline."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.base import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession

SCHEMA = "name string, shape array<bigint>, numbers array<double>, settings string"


class StoredModel(Model, MLWritable, MLReadable):
    """A model that tells its ``state`` (settings for JSON, named arrays) and is made ``from_state`` again.

    The arrays are rows of one Parquet table beside the usual metadata; they are of the model's size.
    """

    def state(self) -> tuple[dict, dict[str, np.ndarray]]:
        raise NotImplementedError

    @classmethod
    def from_state(cls, settings: dict, arrays: dict[str, np.ndarray]) -> StoredModel:
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: StoredModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        settings, arrays = self.model.state()
        rows = [(None, None, None, json.dumps(settings))]
        for name, values in arrays.items():
            values = np.asarray(values, float)
            rows.append((name, list(values.shape), values.ravel().tolist(), None))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, kind: type[StoredModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> StoredModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        settings, arrays = {}, {}
        for row in spark.read.parquet(f"{path}/state").collect():
            if row["name"] is None:
                settings = json.loads(row["settings"])
            else:
                arrays[row["name"]] = np.array(row["numbers"], float).reshape(row["shape"])
        model = self.kind.from_state(settings, arrays)
        model._resetUid(metadata["uid"])
        return model
