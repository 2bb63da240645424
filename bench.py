"""Time the headline queries on $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cohortloom.catalog import QUERIES
from cohortloom.session import local_session

HEADLINE = [
    # records and text
    "record_rejects",
    "record_scalars",
    "record_rules",
    "stage_round_trip",
    "disease_flags",
    "intervention_flags",
    "text_metrics",
    "batched_embedding",
    "hashed_term_vectors",
    # columns, imputation, scaling, vectors
    "constant_columns",
    "median_imputed",
    "mode_imputed",
    "numbers_from_text",
    "standard_scaled",
    "missing_profile",
    "reduced_vectors_kept",
    # sampling
    "stratified_split",
    "stratified_folds",
    "downsampled_even",
    "oversampled",
    # metrics and profiles
    "all_metrics",
    "roc_auc_many_scores",
    "best_threshold",
    "summary_statistics",
    "histogram",
    # ranks and scoring
    "global_rank",
    "risk_buckets",
    "scored_table",
    "chart_top",
    # models and attribution
    "boosted_results",
    "saved_model_scores",
    "boosted_tree_attribution",
    "linear_attribution",
    "grouped_importance_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
