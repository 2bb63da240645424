"""Model families, grid search, repeated evaluation and refit on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators import metrics as m
from cohortloom.operators.boosting import GainBoosting, with_missing
from cohortloom.operators.columns import assemble
from cohortloom.operators.radial import RadialSVM
from cohortloom.operators.sampling import assign_folds, class_weights, oversample, rebalance
from cohortloom.operators.two_tower import TwoTowers

FAMILIES = ("svm", "radial_svm", "forest", "boosted", "network", "gain_boosted", "two_towers")
WEIGHTED_FAMILIES = ("svm", "radial_svm", "forest")
# training rows a task should have at most
ROWS_PER_TASK = 100_000


@dataclass
class Config:
    """One cell of the experiment: family, strategy and tuned parameters."""

    family: str
    input_mode: str = "tabular"
    strategy: str = "class_weight"
    params: dict = field(default_factory=dict)
    # None: the families that take balanced weights under class_weight do
    weighted: bool | None = None

    @property
    def uses_weights(self) -> bool:
        if self.weighted is not None:
            return self.weighted
        return self.strategy == "class_weight" and self.family in WEIGHTED_FAMILIES


def estimator(
    family: str,
    params: Mapping | None = None,
    seed: int = fv.SEED,
    label: str = "label",
    features: str = "features",
    weight: str | None = None,
    size: int | None = None,
    vectors: Sequence[int] = (),
):
    """Unfitted classifier with a ``probability`` column.

    The network scales its inputs itself: places in ``vectors`` to unit deviation, the
    others to 0..1, both as fitted on the training rows.
    """
    common = {"featuresCol": features, "labelCol": label}
    if weight and family not in ("network", "two_towers"):
        common["weightCol"] = weight
    params = dict(params or {})
    if family == "forest":
        return RandomForestClassifier(**common, seed=seed, **params)
    if family == "boosted":
        return GBTClassifier(**common, seed=seed, **params)
    if family == "gain_boosted":
        return GainBoosting(**common, seed=seed, **params)
    if family == "svm":
        # the margin is turned into a probability by a logistic fit on it
        margin = LinearSVC(
            **common, rawPredictionCol="_margin_raw", predictionCol="_margin_label", **params
        )
        as_vector = VectorAssembler(inputCols=["_margin_raw"], outputCol="_margin")
        platt = LogisticRegression(featuresCol="_margin", labelCol=label, standardization=False)
        return Pipeline(stages=[margin, as_vector, platt])
    if family == "radial_svm":
        return RadialSVM(**common, seed=seed, **params)
    if family == "network":
        layers = [size, *params.pop("hidden", [64, 32]), 2]
        scaled = {**common, "featuresCol": "_scaled"}
        network = MultilayerPerceptronClassifier(**scaled, layers=layers, seed=seed, **params)
        return Pipeline(stages=[*_scalers(size, vectors, features), network])
    if family == "two_towers":
        left = size - len(set(vectors))
        towers = TwoTowers(featuresCol="_scaled", labelCol=label, left=left, seed=seed, **params)
        return Pipeline(stages=[*_scalers(size, vectors, features), towers])
    raise ValueError(f"unknown family: {family}")


def _scalers(size: int, vectors: Sequence[int], features: str) -> list:
    """Stages from ``features`` to ``_scaled``."""
    plain = [i for i in range(size) if i not in set(vectors)]
    stages, parts = [], []
    if plain:
        stages.append(VectorSlicer(inputCol=features, outputCol="_plain", indices=plain))
        stages.append(MinMaxScaler(inputCol="_plain", outputCol="_plain_scaled"))
        parts.append("_plain_scaled")
    if vectors:
        stages.append(VectorSlicer(inputCol=features, outputCol="_vector", indices=list(vectors)))
        scaler = StandardScaler(inputCol="_vector", outputCol="_vector_scaled", withMean=True)
        stages.append(scaler)
        parts.append("_vector_scaled")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="_scaled")]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a large table dealt evenly, so that a table in few files does not become the work of few tasks.

    Iterative fits read their rows once a pass; a small table is left as it lies.
    """
    tasks = rows.count() // ROWS_PER_TASK
    if not tasks:
        return rows
    return rows.repartition(max(tasks + 1, rows.sparkSession.sparkContext.defaultParallelism))


def vector_places(cols: Sequence[str]) -> list[int]:
    return [i for i, c in enumerate(cols) if c.startswith(fv.PCA_PREFIX)]


def param_grid(base, grid: Mapping[str, Sequence]):
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(base.getParam(name), list(values))
    return builder.build()


def search(
    train: DataFrame,
    family: str,
    grid: Mapping[str, Sequence],
    id_col: str,
    label: str = "label",
    folds: int = fv.FOLDS,
    seed: int = fv.SEED,
    weight: str | None = None,
    parallelism: int = 4,
) -> tuple[dict, float]:
    """Best parameters and their cross-validated ROC-AUC over stratified folds."""
    base = estimator(family, seed=seed, label=label, weight=weight)
    grid_maps = param_grid(base, grid)
    folded = assign_folds(train, id_col, label, folds, seed, "fold")
    evaluator = BinaryClassificationEvaluator(labelCol=label, numBins=0)
    folded = folded.persist()
    total = [0.0] * len(grid_maps)
    for fold in range(folds):
        held = folded.filter(F.col("fold") == fold)
        models = base.fitMultiple(folded.filter(F.col("fold") != fold), grid_maps)

        def judged(_, models=models, held=held):
            place, model = next(models)
            return place, evaluator.evaluate(model.transform(held))

        with ThreadPool(min(parallelism, len(grid_maps))) as pool:
            for place, area in pool.imap_unordered(inheritable_thread_target(train.sparkSession)(judged), grid_maps):
                total[place] += area
    folded.unpersist()
    best = max(range(len(grid_maps)), key=lambda i: total[i])
    chosen = {param.name: value for param, value in grid_maps[best].items()}
    return chosen, total[best] / folds


def prepared(
    train: DataFrame, config: Config, id_col: str, label: str, seed: int, ratio: float | None = None
) -> DataFrame:
    """Training rows of one run: resampled by strategy, weighted where the family is."""
    if config.strategy.startswith("oversample_"):
        ratio = float(config.strategy.removeprefix("oversample_"))
        rows = oversample(train, label, id_col, ratio, seed)
    else:
        rows = rebalance(train, label, id_col, config.strategy, seed, ratio)
    return class_weights(rows, label) if config.uses_weights else rows


def fit(
    train: DataFrame, config: Config, id_col: str, label: str, seed: int, cols: Sequence[str]
):
    rows = prepared(train, config, id_col, label, seed)
    weight = "weight" if config.uses_weights else None
    chosen = estimator(
        config.family, config.params, seed, label, weight=weight, size=len(cols), vectors=vector_places(cols)
    )
    return chosen.fit(rows)


def run_metrics(
    model, test: DataFrame, label: str, validation: DataFrame | None = None
) -> dict[str, float]:
    """Five metrics of one fitted model; the scored rows (three numbers each) are kept meanwhile.

    With ``validation`` the decision threshold is the one with the best F1 there.
    """
    score = vector_to_array("probability")[1].alias("score")
    scored = model.transform(test).select(label, "prediction", score)
    if validation is not None:
        held = model.transform(validation).select(label, score)
        threshold = m.best_threshold(held, "score", label).first()["threshold"]
        scored = scored.withColumn("prediction", (F.col("score") >= threshold).cast("double"))
    scored = scored.persist()
    found = m.evaluate_scores(scored, label, "score", "prediction").first().asDict()
    scored.unpersist()
    return {name: float(found[name]) for name in fv.METRICS}


def evaluate(
    data: DataFrame,
    cols: Sequence[str],
    configs: Sequence[Config],
    id_col: str,
    label: str = "label",
    split: str = "split",
    runs: int = fv.RUNS,
    seed: int = fv.SEED,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = fv.FOLDS,
) -> DataFrame:
    """Long results: family, mode, strategy, metric, mean, std (and ``seq``, the run order).

    The assembled frame is cached once. A grid is searched once per boosted family
    and once per strategy for forests; then every configuration is trained ``runs``
    times with seed + run.
    """
    return evaluate_tuned(data, cols, configs, id_col, label, split, runs, seed, grids, folds)[0]


def evaluate_tuned(
    data: DataFrame,
    cols: Sequence[str],
    configs: Sequence[Config],
    id_col: str,
    label: str = "label",
    split: str = "split",
    runs: int = fv.RUNS,
    seed: int = fv.SEED,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = fv.FOLDS,
) -> tuple[DataFrame, list[Config]]:
    """Results as of ``evaluate``, and copies of the configurations with the parameters found."""
    target = F.col(label).cast("double").alias(label)
    assembled = assemble(spread(data.select(id_col, target, split, *cols)), cols)
    frame = assembled.select(id_col, label, split, "features").persist()
    train, test = frame.filter(F.col(split) == "train"), frame.filter(F.col(split) == "test")
    validation = frame.filter(F.col(split) == "validation")
    tuned: dict[tuple, dict] = {}
    rows, used = [], []
    for seq, config in enumerate(configs):
        grid = (grids or {}).get(config.family)
        if grid:
            key = (config.family, config.uses_weights if config.family == "forest" else None)
            if key not in tuned:
                weighted = class_weights(train, label) if config.uses_weights else train
                weight = "weight" if config.uses_weights else None
                tuned[key], _ = search(
                    weighted, config.family, grid, id_col, label, folds, seed, weight
                )
            config = replace(config, params={**config.params, **tuned[key]})
        used.append(config)
        for run in range(runs):
            model = fit(train, config, id_col, label, seed + run, cols)
            held = validation if config.family in ("network", "two_towers") else None
            found = run_metrics(model, test, label, held)
            named = (config.family, config.input_mode, config.strategy)
            rows.append((seq, *named, run, *found.values()))
    frame.unpersist()
    keys = ["seq", "model_name", "input_mode", "imbalance_strategy"]
    metric_types = ", ".join(f"{x} double" for x in fv.METRICS)
    per_run = data.sparkSession.createDataFrame(
        rows,
        f"seq int, model_name string, input_mode string, imbalance_strategy string, run int, {metric_types}",
    )
    return m.to_long(m.summarise_runs(per_run, keys), keys), used


def select_features(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    ratio: float = 1.0,
    min_keep: int = fv.MIN_SELECTED_FEATURES,
    seed: int = fv.SEED,
    params: Mapping = fv.SELECTION_PARAMS,
    family: str = "boosted",
) -> tuple[list[str], DataFrame]:
    """Features whose boosted-tree importance is above mean * ratio, at least ``min_keep``.

    Returns the kept names in column order and the importance table. The family ``gain_boosted`` goes by
    average gains, ``boosted`` by Spark's importance.
    """
    frame = spread(df.select(F.col(label).cast("double").alias(label), *cols))
    frame = with_missing(frame, cols) if family == "gain_boosted" else assemble(frame, cols)
    model = estimator(family, params, seed, label).fit(frame)
    found = model.importances if family == "gain_boosted" else model.featureImportances.toArray()
    weights = [float(x) for x in found]
    limit = sum(weights) / len(weights) * ratio
    kept = {c for c, w in zip(cols, weights) if w > limit}
    if len(kept) < min_keep:
        order = sorted(range(len(cols)), key=lambda i: weights[i])
        kept = {cols[i] for i in order[-min_keep:]}
    rows = [(c, w, c in kept) for c, w in zip(cols, weights)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double, kept boolean")
    return [c for c in cols if c in kept], table


def refit(
    data: DataFrame,
    cols: Sequence[str],
    config: Config,
    id_col: str,
    label: str = "label",
    seed: int = fv.SEED,
) -> PipelineModel:
    """Train the chosen configuration with its tuned parameters, as a saveable pipeline."""
    rows = spread(data.select(id_col, F.col(label).cast("double").alias(label), *cols))
    rows = prepared(rows, config, id_col, label, seed)
    weight = "weight" if config.uses_weights else None
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="features"),
        estimator(
            config.family, config.params, seed, label, weight=weight, size=len(cols), vectors=vector_places(cols)
        ),
    ]
    return Pipeline(stages=stages).fit(rows)
