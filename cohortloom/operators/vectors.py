"""Text to vector inference and variance-based reduction of vector columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF,
    PCA,
    ElementwiseProduct,
    HashingTF,
    Normalizer,
    RegexTokenizer,
    StandardScaler,
)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from cohortloom import fixed_values as fv

Encoder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    text_col: str,
    make_encoder: Callable[[], Encoder],
    batch_size: int = fv.EMBEDDING_BATCH,
    out: str = "embedding",
) -> DataFrame:
    """Batched inference; a null text gives a null vector.

    ``make_encoder`` runs once per Python worker and returns a function from a list
    of texts to an array with one row per text (truncation is the encoder's).
    """

    def make_predict():
        encode = make_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            return encode([t or "" for t in texts]).astype(np.float32)

        return predict

    infer = predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size
    )
    text = F.col(text_col)
    return df.withColumn(out, F.when(text.isNotNull(), infer(F.coalesce(text, F.lit("")))))


def fit_text_vectors(df: DataFrame, text_col: str, size: int = 256) -> PipelineModel:
    """JVM-side stand-in for a language model: hashed terms, inverse frequency, unit length."""
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_terms", pattern=r"\p{L}+", gaps=False),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=size),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_vector"),
    ]
    return Pipeline(stages=stages).fit(df.select(F.coalesce(text_col, F.lit("")).alias("_text")))


def text_vectors(
    df: DataFrame, text_col: str, model: PipelineModel, out: str = "embedding"
) -> DataFrame:
    """Apply a fitted text pipeline; a null text gives a null vector."""
    filled = df.withColumn("_text", F.coalesce(text_col, F.lit("")))
    vector = vector_to_array("_vector", "float32")
    return model.transform(filled).select(
        *df.columns, F.when(F.col(text_col).isNotNull(), vector).alias(out)
    )


def valid_vector(array: Column) -> Column:
    """True when the vector is there and at least one element is a number."""
    return F.coalesce(F.exists(array, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


@dataclass
class VectorReduction:
    """A fitted scaling and rotation; ``kept`` components hold the wanted variance."""

    pipeline: PipelineModel
    size: int
    kept: int
    variance: list[float]


def _scaled(df: DataFrame, array_col: str) -> DataFrame:
    return df.withColumn("_raw", array_to_vector(F.col(array_col).cast("array<double>")))


def fit_reduction(
    df: DataFrame, array_col: str, variance: float = fv.VARIANCE_KEPT
) -> VectorReduction:
    """Standardise (population deviation), rotate, keep the fewest components above ``variance``.

    Means, deviations and the size x size product are tree aggregates, so only
    model-sized data reaches the driver. A constant element stays out of the rotation.
    """
    valid = df.filter(valid_vector(F.col(array_col)))
    shape = valid.agg(F.max(F.size(array_col)).alias("size"), F.count("*").alias("rows")).first()
    size, rows = shape["size"], shape["rows"]
    if not rows:
        raise ValueError("no valid vectors")
    # the scaler divides by the sample deviation; this turns it into the population one
    factor = float(np.sqrt(rows / (rows - 1))) if rows > 1 else 1.0
    stages = [
        StandardScaler(inputCol="_raw", outputCol="_standard", withMean=True, withStd=True),
        ElementwiseProduct(
            inputCol="_standard", outputCol="_scaled", scalingVec=Vectors.dense([factor] * size)
        ),
        PCA(k=size, inputCol="_scaled", outputCol="_rotated"),
    ]
    pipeline = Pipeline(stages=stages).fit(_scaled(valid.select(array_col), array_col))
    ratios = [float(x) for x in pipeline.stages[-1].explainedVariance]
    kept = next((i for i, total in enumerate(accumulate(ratios), 1) if total > variance), size)
    return VectorReduction(pipeline, size, kept, ratios)


def apply_reduction(
    df: DataFrame, array_col: str, reduction: VectorReduction, out: str = "pca"
) -> DataFrame:
    """Kept components of every valid vector; null where there is none."""
    valid = valid_vector(F.col(array_col))
    zero = F.array_repeat(F.lit(0.0), reduction.size)
    filled = df.withColumn("_filled", F.when(valid, F.col(array_col).cast("array<double>")))
    filled = _scaled(filled.withColumn("_filled", F.coalesce("_filled", zero)), "_filled")
    rotated = reduction.pipeline.transform(filled)
    components = F.slice(vector_to_array("_rotated"), 1, reduction.kept)
    return rotated.select(*df.columns, F.when(valid, components).alias(out))


def reduction_report(df: DataFrame, array_col: str, reduction: VectorReduction) -> DataFrame:
    """One row: sizes before and after, compression, variance kept, valid and missing rows."""
    valid = valid_vector(F.col(array_col))
    return df.agg(
        F.count_if(valid).alias("valid_rows"),
        F.count_if(~valid).alias("missing_rows"),
        F.lit(reduction.size).alias("original_size"),
        F.lit(reduction.kept).alias("reduced_size"),
        F.lit(reduction.size / reduction.kept).alias("compression"),
        F.lit(sum(reduction.variance[: reduction.kept])).alias("variance_kept"),
    )


def standardise_vectors(df: DataFrame, array_col: str, out: str = "scaled") -> DataFrame:
    """Element-wise (x - mean) / population deviation over all vectors; constants divide by 1."""
    vector = array_to_vector(F.col(array_col).cast("array<double>"))
    found = df.filter(F.col(array_col).isNotNull()).agg(
        Summarizer.mean(vector).alias("mean"),
        Summarizer.std(vector).alias("std"),
        F.count("*").alias("rows"),
    ).first()
    # the summarizer divides by rows - 1
    factor = np.sqrt((found["rows"] - 1) / found["rows"])
    means = F.array(*[F.lit(float(m)) for m in found["mean"].toArray()])
    divisors = F.array(*[F.lit(float(d) or 1.0) for d in found["std"].toArray() * factor])
    centred = F.zip_with(F.col(array_col).cast("array<double>"), means, lambda x, m: x - m)
    return df.withColumn(out, F.zip_with(centred, divisors, lambda x, d: x / d))
