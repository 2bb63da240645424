"""Dataset build: raw lines to the labelled modelling table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions.nested import label_from_status
from cohortloom.functions.text import joined_all
from cohortloom.operators import columns, flags, vectors
from cohortloom.operators.records import drop_unlabelled, parse_all
from cohortloom.plans.stages import Stages, files_mark
from cohortloom.session import sibling_session
from cohortloom.sources.records import first_existing, read_lines
from cohortloom.sources.tables import read_stage, write_stage

STAGES = ("records", "embedded", "reduced", "final")
KNOWN_STATUSES = sorted({*fv.POSITIVE_STATUSES, *fv.NEGATIVE_STATUSES, *fv.ONGOING_STATUSES, *fv.COHORT_STATUSES})


def parse_counts(parsed: DataFrame) -> dict[str, Column]:
    """Aggregates over parsed rows: kept and rejected ones, and of the kept ones labels, statuses, missing values."""
    kept = F.col("kept")
    label, status = label_from_status(F.col("overall_status")), F.upper("overall_status")
    known = status.isin(*KNOWN_STATUSES)
    counts = {"kept": kept, "rejected": ~kept, "label_1": kept & (label == 1), "label_0": kept & (label == 0)}
    counts |= {"label_missing": kept & label.isNull()}
    counts |= {f"status_{name}": kept & (status == name) for name in KNOWN_STATUSES}
    counts |= {"status_other": kept & ~F.coalesce(known, F.lit(False))}
    own = [c for c in parsed.columns if c not in ("kept", "rejected_line", "reject_reason")]
    counts |= {f"missing_{c}": kept & F.col(f"`{c}`").isNull() for c in own}
    return {name: F.count_if(test) for name, test in counts.items()}


def parse_stage(
    spark: SparkSession, full_path: str, search_path: str, out: str
) -> tuple[str, str, dict[str, int]]:
    """Parse the full file, or the search file in its place, into table and rejects.

    Both are written by one pass over the lines, which also counts (``parse_counts``): the metrics
    belong to the writing tasks, nothing is read again. Returns the two paths and the counts.
    """
    path = first_existing(spark, [full_path, search_path])
    # a session that has observed a frame cannot ship fitted models, which may refer to it, so this one is apart
    parsed = parse_all(read_lines(sibling_session(spark), path), wrapped=path == full_path)
    observed = Observation()
    counts = [test.alias(name) for name, test in parse_counts(parsed).items()]
    write_stage(parsed.observe(observed, *counts), out, partition_by=["kept"])
    # a side without rows gets an empty file, so that both paths can be read
    nothing = spark.createDataFrame([], parsed.drop("kept").schema).coalesce(1)
    for side in ("true", "false"):
        nothing.write.mode("append").parquet(f"{out}/kept={side}")
    return f"{out}/kept=true", f"{out}/kept=false", observed.get


def feature_stage(parsed: DataFrame) -> DataFrame:
    """Disease flags, intervention flags and text metrics; narrow expressions only."""
    flagged = flags.add_intervention_flags(flags.add_disease_flags(parsed))
    return flags.add_text_metrics(flagged)


def embedding_stage(
    features: DataFrame,
    make_encoder: Callable | None = None,
    size: int = 256,
    fields: Sequence[str] = tuple(fv.DESCRIPTION_FIELDS),
) -> DataFrame:
    """Description text of all fields and its vector (hashed terms when there is no encoder)."""
    present = [F.col(c) for c in fields if c in features.columns]
    described = features.withColumn(
        "description_text", joined_all(*present) if present else F.lit("")
    )
    if make_encoder:
        return vectors.embed(described, "description_text", make_encoder)
    model = vectors.fit_text_vectors(described, "description_text", size)
    return vectors.text_vectors(described, "description_text", model)


def reduction_stage(
    embedded: DataFrame, fit_on: DataFrame | None = None, variance: float = fv.VARIANCE_KEPT
) -> tuple[DataFrame, vectors.VectorReduction]:
    """Reduced vectors; the rotation is fitted on ``fit_on`` (all rows when it is not given)."""
    reduction = vectors.fit_reduction(embedded if fit_on is None else fit_on, "embedding", variance)
    return vectors.apply_reduction(embedded, "embedding", reduction), reduction


def final_stage(reduced: DataFrame, kept: int) -> DataFrame:
    """Labelled rows with the vector components as columns and no raw embedding."""
    relabelled = reduced.withColumn(fv.LABEL_COLUMN, label_from_status(F.col("overall_status")))
    wide = columns.expand_vector(drop_unlabelled(relabelled), "pca", kept, fv.PCA_PREFIX)
    return wide.drop("embedding", "pca")


def build_dataset(
    spark: SparkSession,
    full_path: str,
    search_path: str,
    out_dir: str,
    make_encoder: Callable | None = None,
    size: int = 256,
    encoder_name: str | None = None,
    start: str | None = None,
    until: str = STAGES[-1],
) -> dict[str, str]:
    """Run all stages; returns the paths of parsed, rejects, embedded, reduced and final.

    A run goes on behind the last stage that is committed in ``out_dir`` and was made from the same files
    and parameters. ``start`` names a stage from which on all run anew, ``until`` the last one to run. An
    encoder is known by ``encoder_name``, or by its function's name.
    """
    for name in (start, until):
        if name is not None and name not in STAGES:
            raise ValueError(f"unknown stage: {name}")
    stages, paths = Stages(spark, out_dir, start), {}
    source = first_existing(spark, [full_path, search_path])
    made_from = {"source": source, "wrapped": source == full_path, "files": files_mark(spark, source)}
    records = stages.run("records", made_from, lambda out: parse_stage(spark, full_path, search_path, out)[2])
    paths |= {"parsed": f"{records.path}/kept=true", "rejects": f"{records.path}/kept=false"}
    if until == "records":
        return paths

    def embed(out: str) -> None:
        features = feature_stage(read_stage(spark, paths["parsed"]).drop("rejected_line", "reject_reason"))
        write_stage(embedding_stage(features, make_encoder, size), out)

    if make_encoder:
        encoder_name = encoder_name or f"{make_encoder.__module__}.{make_encoder.__qualname__}"
    embedded = stages.run("embedded", {"records": records.fingerprint, "size": size, "encoder": encoder_name}, embed)
    paths["embedded"] = embedded.path
    if until == "embedded":
        return paths

    def reduce(out: str) -> dict:
        rows, reduction = reduction_stage(read_stage(spark, embedded.path))
        write_stage(rows, out)
        return {"kept": reduction.kept}

    reduced = stages.run("reduced", {"embedded": embedded.fingerprint}, reduce)
    paths["reduced"] = reduced.path
    if until == "reduced":
        return paths

    def finish(out: str) -> None:
        write_stage(final_stage(read_stage(spark, reduced.path), reduced.details["kept"]), out)

    paths["final"] = stages.run("final", {"reduced": reduced.fingerprint}, finish).path
    return paths
