"""Experiments: split, select, train all configurations, keep the best model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators import columns as c
from cohortloom.operators.impute import apply_impute, coerce_numeric, fit_impute
from cohortloom.operators.metrics import best_config
from cohortloom.operators.sampling import assign_split
from cohortloom.operators.training import Config, evaluate_tuned, refit, select_features
from cohortloom.sources.models import save_model


def all_configs(families: Sequence[str] = ("svm", "forest", "boosted", "network")) -> list[Config]:
    """The 20 configurations of a full run, without those of left-out families."""
    strategies = list(fv.STRATEGY_RATIOS)
    configs = [Config("svm", "tabular", "class_weight")]
    for family in ("forest", "boosted"):
        configs += [Config(family, mode, s) for mode in fv.INPUT_MODES for s in strategies]
    configs += [
        Config("network", "tabular_plus_embeddings", f"oversample_{r}") for r in fv.OVERSAMPLE_RATIOS
    ]
    return [x for x in configs if x.family in families]


def model_view(
    table: DataFrame, mode: str, id_col: str = fv.ID_COLUMN, label: str = fv.LABEL_COLUMN
) -> tuple[DataFrame, list[str]]:
    """Numeric features of a mode with their split: constants dropped, train medians filled in."""
    view = c.feature_view(table, mode, label, id_col)
    cols = [x for x in view.columns if x not in (id_col, label)]
    constant = set(c.constant_columns(view, cols))
    cols = [x for x in cols if x not in constant]
    split = assign_split(view.select(id_col, label, *cols), id_col, label)
    fitted = fit_impute(split.filter(F.col("split") == "train"), cols)
    filled = apply_impute(split, fitted)
    return coerce_numeric(filled, cols), cols


def final_config(config: Config) -> Config:
    """What the best configuration is refitted as: a linear machine becomes a balanced radial one."""
    if config.family == "svm":
        return replace(config, family="radial_svm", params={}, weighted=True)
    return config


def run_experiments(
    table: DataFrame,
    configs: Sequence[Config],
    out_dir: str | None = None,
    runs: int = fv.RUNS,
    grids: Mapping = fv.GRIDS,
    folds: int = fv.FOLDS,
    select: bool = True,
    selection_params: Mapping = fv.SELECTION_PARAMS,
    id_col: str = fv.ID_COLUMN,
    label: str = fv.LABEL_COLUMN,
) -> DataFrame:
    """Long results of all configurations; the best one is refitted and saved to ``out_dir``
    (a linear machine as a radial one).

    ``grids`` holds the parameters searched per family, the full ones by default; an empty
    mapping trains with the parameters given in ``configs``.
    """
    results, views, offset, tuned = None, {}, 0, []
    for mode in dict.fromkeys(x.input_mode for x in configs):
        data, cols = model_view(table, mode, id_col, label)
        if select:
            train = data.filter(F.col("split") == "train")
            cols, _ = select_features(train, cols, label, params=selection_params)
        chosen = [x for x in configs if x.input_mode == mode]
        views[mode] = (data, cols)
        found, used = evaluate_tuned(data, cols, chosen, id_col, label, runs=runs, grids=grids, folds=folds)
        tuned += used
        found = found.withColumn("seq", F.col("seq") + offset)
        offset += len(chosen)
        results = found if results is None else results.unionByName(found)
    if out_dir:
        best = best_config(results).first()
        config = next(
            x
            for x in tuned
            if (x.family, x.input_mode, x.strategy)
            == (best["model_name"], best["input_mode"], best["imbalance_strategy"])
        )
        data, cols = views[config.input_mode]
        model = refit(data.filter(F.col("split") == "train"), cols, final_config(config), id_col, label)
        save_model(
            model,
            {
                "model_name": config.family,
                "input_mode": config.input_mode,
                "imbalance_strategy": config.strategy,
                "roc_auc": best["mean"],
                "roc_auc_std": best["std"],
                "feature_names": cols,
                "random_state": fv.SEED,
            },
            out_dir,
        )
    return results
