"""Fitted pipelines with their metadata."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

METADATA = (
    "model_name string, input_mode string, imbalance_strategy string, roc_auc double, "
    "roc_auc_std double, feature_names array<string>, random_state int"
)


def save_model(model: PipelineModel, metadata: dict, path: str) -> None:
    """Write ``path/model`` and the one-row JSON table ``path/metadata``."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    names = [part.split()[0] for part in METADATA.split(", ")]
    row = tuple(metadata.get(name) for name in names)
    table = spark.createDataFrame([row], METADATA)
    table.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    model = PipelineModel.load(f"{path}/model")
    metadata = spark.read.schema(METADATA).json(f"{path}/metadata").first().asDict()
    return model, metadata
