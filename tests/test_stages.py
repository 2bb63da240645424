"""Committed stages: going on after a break, changed inputs, counts of a parse."""

import pytest
from pyspark.sql import functions as F
from test_plans import lines

from cohortloom.plans import dataset
from cohortloom.plans.stages import Stages, files_mark
from cohortloom.sources.tables import read_stage


def write(path, rows):
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(rows) + "\n")


def test_a_broken_run_goes_on_and_a_changed_file_runs_anew(spark, scratch, monkeypatch):
    path, out = f"{scratch}/stages.jsonl", f"{scratch}/restarted"
    rows = list(lines(80))
    write(path, rows)
    ran, plain = [], {n: getattr(dataset, n) for n in ("parse_stage", "embedding_stage", "reduction_stage", "final_stage")}
    broken = {"reduction_stage"}

    def watched(name):
        def stage(*args):
            ran.append(name)
            if name in broken:
                raise RuntimeError(name)
            return plain[name](*args)

        return stage

    for name in plain:
        monkeypatch.setattr(dataset, name, watched(name))

    def build(**options):
        ran.clear()
        return dataset.build_dataset(spark, path, f"{path}-none", out, size=8, **options)

    with pytest.raises(RuntimeError):
        build()
    assert ran == ["parse_stage", "embedding_stage", "reduction_stage"]
    broken.clear()
    paths = build()
    assert ran == ["reduction_stage", "final_stage"]
    assert build() == paths and ran == []
    assert read_stage(spark, paths["final"]).count() > 0
    assert set(build(until="embedded")) == {"parsed", "rejects", "embedded"}
    again = build(start="final")
    assert ran == ["final_stage"] and again["final"] != paths["final"] and again["reduced"] == paths["reduced"]
    one, two = (read_stage(spark, x["final"]) for x in (paths, again))
    assert one.columns == two.columns and one.exceptAll(two).count() == 0 == two.exceptAll(one).count()
    with pytest.raises(ValueError):
        build(start="middle")

    # a file that changed makes all stages new
    write(path, rows[:60])
    changed = build()
    assert ran == list(plain) and read_stage(spark, changed["parsed"]).count() == 60


def test_counts_of_a_parse(spark, scratch):
    path, out = f"{scratch}/counted.jsonl", f"{scratch}/counted"
    write(path, lines(90))
    kept, rejects, counts = dataset.parse_stage(spark, path, f"{path}-none", out)
    table = read_stage(spark, kept)
    assert (counts["kept"], counts["rejected"]) == (table.count(), read_stage(spark, rejects).count()) == (90, 1)
    by_status = {r[0]: r[1] for r in table.groupBy("overall_status").count().collect()}
    assert {n: counts[f"status_{n}"] for n in by_status} == by_status
    assert sum(v for n, v in counts.items() if n.startswith("status_")) == 90
    completed = by_status["COMPLETED"]
    assert counts["label_1"] == completed
    assert counts["label_0"] == sum(by_status.get(n, 0) for n in dataset.fv.NEGATIVE_STATUSES)
    assert counts["label_1"] + counts["label_0"] + counts["label_missing"] == 90
    names = [c for c in table.columns if c not in ("rejected_line", "reject_reason")]
    missing = table.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing_{c}") for c in names]).first().asDict()
    assert {n: counts[n] for n in missing} == missing


def test_manifests_that_are_missing_or_empty(spark, scratch):
    stages = Stages(spark, f"{scratch}/odd")
    asked = []

    def build(out):
        asked.append(out)
        spark.range(3).write.parquet(out)
        return {"rows": 3}

    assert stages.committed("a") is None
    one = stages.run("a", {"x": 1}, build)
    assert (one.reused, one.details, spark.read.parquet(one.path).count()) == (False, {"rows": 3}, 3)
    assert stages.run("a", {"x": 1}, build).reused and not stages.run("a", {"x": 2}, build).reused
    spark.createDataFrame([], "fingerprint string").write.mode("overwrite").json(f"{scratch}/odd/committed/a")
    assert stages.committed("a") is None and not stages.run("a", {"x": 2}, build).reused
    assert len(set(asked)) == 3
    assert files_mark(spark, one.path) == files_mark(spark, one.path) != files_mark(spark, asked[-1])
