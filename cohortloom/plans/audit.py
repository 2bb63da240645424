"""Attribution of a model's test scores and the leakage audit."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators import attribution as a
from cohortloom.operators.kernel_attribution import kernel_attribution
from cohortloom.operators.sampling import sample_n
from cohortloom.session import cut_lineage


def explained(features: DataFrame, model, names: list[str], id_col: str) -> DataFrame:
    """Id, features and their contributions (``phi_`` columns) under a fitted pipeline.

    Trees get exact path attribution; the linear family gets weight times deviation, which
    adds up to the margin minus its mean. Any other family gets kernel attribution of its probability.
    """
    last = model.stages[-1]
    if isinstance(last, PipelineModel) and isinstance(last.stages[0], LinearSVCModel):
        weights = dict(zip(names, (float(w) for w in last.stages[0].coefficients.toArray())))
        return a.linear_attribution(features, weights)
    if not hasattr(last, "treeWeights"):
        def scored(rows: DataFrame) -> DataFrame:
            return model.transform(rows).withColumn("score", vector_to_array("probability")[1])

        return kernel_attribution(features, scored, names, id_col)
    parts = a.tree_attribution(model.stages[0].transform(features), last)
    return parts.select(
        id_col, *names, *[F.col("phi")[i].alias(f"phi_{n}") for i, n in enumerate(names)]
    )


def audit_model(
    features: DataFrame,
    model,
    names: list[str],
    id_col: str = fv.ID_COLUMN,
    rows: int | None = None,
    shown: int = 20,
    detailed: int = 5,
) -> dict[str, DataFrame]:
    """Importance tables (raw, grouped), dependence, direction and leakage report.

    ``features`` holds the id and the named numeric columns; every row is explained unless
    ``rows`` asks for a sample. The importance tables list the first ``shown`` features,
    dependence and direction the first ``detailed`` groups.
    """
    used = features.select(id_col, *names)
    used = used if rows is None else sample_n(used, id_col, rows)
    wide = cut_lineage(explained(used, model, names, id_col))
    raw = a.mean_abs(wide, [f"phi_{n}" for n in names], prefix="phi_")
    grouped = a.importance_table(raw, shown, grouped=True)
    top = [row["feature"] for row in grouped.orderBy("rank").limit(detailed).collect()]
    return {
        "raw": a.importance_table(raw, shown),
        "grouped": grouped,
        "dependence": a.dependence(wide, top, names),
        "direction": a.direction(a.report_points(wide, top, names)),
        "leakage": a.leakage_audit(a.name_table(features.sparkSession, names)),
    }
