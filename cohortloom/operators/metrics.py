"""Classification metrics, repeated-run summaries and threshold search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv

MIN_SCORE_RANGES = 256


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(denominator == 0, 0.0).otherwise(numerator / denominator)


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def confusion(label: Column, prediction: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((label == 1) & (prediction == 1)),
        "fp": F.count_if((label == 0) & (prediction == 1)),
        "fn": F.count_if((label == 1) & (prediction == 0)),
        "tn": F.count_if((label == 0) & (prediction == 0)),
    }


def binary_metrics(
    df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 from one conditional-sum aggregate."""
    counts = confusion(F.col(label), F.col(prediction))
    summed = df.groupBy(*keys).agg(*[c.alias(name) for name, c in counts.items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return summed.select(
        *keys,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )


def _score_ranges(df: DataFrame, score: str) -> list[float]:
    """Cut points that split the rows into ranges of about equal size.

    A score shared by many rows gives one cut; it is a single row once counted. There
    are at least two ranges per shuffle partition, so ranges stay as small as those.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(MIN_SCORE_RANGES, 2 * partitions)
    grid = [i / ranges for i in range(1, ranges)]
    sketch = F.percentile_approx(F.col(score).cast("double"), grid, 8 * ranges)
    cuts = df.agg(sketch).first()[0] or []
    return [float("-inf"), *sorted(set(cuts)), float("inf")]


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact, tie-aware area under the ROC curve: one row, column ``roc_auc``.

    Rows are first counted per distinct score, so a score shared by many rows is one
    row from then on. Each range of scores is then summed up on its own, and only one
    row per range is left for the final running total. Rows without a score or label, and
    scores that are not a number, are left out.
    """
    rated = df.filter(
        F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()
    )
    ranges = Bucketizer(splits=_score_ranges(rated, score), inputCol="score", outputCol="range")
    per_score = rated.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    lower = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    neg_below = F.coalesce(F.sum("neg").over(lower), F.lit(0))
    per_range = (
        ranges.transform(per_score)
        .select("range", "pos", "neg", (F.col("pos") * (neg_below + F.col("neg") / 2)).alias("won"))
        .groupBy("range")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    neg_before = F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    totals = per_range.select(
        (F.col("won") + F.col("pos") * neg_before).alias("won"), "pos", "neg"
    ).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pairs = F.col("pos").cast("double") * F.col("neg")
    return totals.select(F.when(pairs > 0, F.col("won") / pairs).alias("roc_auc"))


def evaluate_scores(df: DataFrame, label: str, score: str, prediction: str) -> DataFrame:
    """All five metrics in one row."""
    area = roc_auc(df, label, score).scalar()
    return binary_metrics(df, label, prediction).select("*", area.alias("roc_auc"))


def summarise_runs(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(fv.METRICS)
) -> DataFrame:
    """Mean and sample deviation of every metric over the runs of each configuration."""
    return df.groupBy(*keys).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
    )


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(fv.METRICS)) -> DataFrame:
    """Summary columns to rows: keys, metric_name, mean, std; one narrow pass."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric_name"),
                F.col(f"{m}_mean").alias("mean"),
                F.col(f"{m}_std").alias("std"),
            )
            for m in metrics
        ]
    )
    return df.select(*keys, F.inline(rows))


def best_per_metric(
    results: DataFrame, order: str = "seq", metrics: Sequence[str] = ("roc_auc", "f1", "accuracy")
) -> DataFrame:
    """The row with the highest mean per metric; the first in ``order`` on ties."""
    wanted = results.filter(F.col("metric_name").isin(*metrics) & F.col("mean").isNotNull())
    others = [c for c in results.columns if c not in ("metric_name", order)]
    best = F.max_by(
        F.struct(*others), F.struct(F.col("mean"), -F.col(order))
    ).alias("best")
    return wanted.groupBy("metric_name").agg(best).select("metric_name", "best.*")


def best_config(results: DataFrame, metric: str = "roc_auc", order: str = "seq") -> DataFrame:
    """The single best row of a metric."""
    return best_per_metric(results, order, [metric])


# --- fixed values: decision thresholds tried, 0.10 to 0.95 in steps of 0.05 --
THRESHOLDS = [0.1 + 0.05 * i for i in range(18)]


def threshold_scores(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float] = tuple(THRESHOLDS)
) -> DataFrame:
    """F1 per threshold; a row is predicted 1 when its score is at least the threshold.

    All thresholds are counted in the same single-row aggregate.
    """
    positive = F.col(label) == 1
    counts = [F.count_if(positive).alias("pos")]
    rows = []
    for i, cut in enumerate(thresholds):
        reached = F.col(score) >= cut
        counts += [
            F.count_if(reached & positive).alias(f"tp{i}"),
            F.count_if(reached & (F.col(label) == 0)).alias(f"fp{i}"),
        ]
        f1 = _ratio(2 * F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}") + F.col("pos"))
        rows.append(F.struct(F.lit(cut).alias("threshold"), f1.alias("f1")))
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def best_threshold(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float] = tuple(THRESHOLDS)
) -> DataFrame:
    """Threshold with the highest F1, the lowest one on ties; 0.5 when no F1 is above 0."""
    scored = threshold_scores(df, score, label, thresholds)
    best = scored.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"))
    found = F.col("b.f1") > 0
    return best.select(
        F.when(found, F.col("b.threshold")).otherwise(0.5).alias("threshold"),
        F.coalesce("b.f1", F.lit(0.0)).alias("f1"),
    )
