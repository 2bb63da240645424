import os
import sys
import tempfile

import pytest
from llm_fixtures import SMALL, TOKEN, table

import __spark_entry__
import corpus_pipeline
from cohortloom.llm import decontamination, near_duplicates, quality
from cohortloom.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered():
    names = sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_stages_work_on_what_their_predecessors_kept(spark):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "best_fit_packing":
            assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        kept[name] = spark.read.parquet(f"{folder}/{name}")
        if name == "quality_classifier":
            scores = quality.score_quality(docs, labels)
            wanted = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
            assert {r["doc_id"] for r in kept[name].collect()} == wanted
        if name == "ngram_jaccard_join":
            classes = near_duplicates.similar_documents(docs).select("class_id").distinct().count()
            assert kept[name].count() == classes
            assert near_duplicates.similar_documents(kept[name]).where("n_links > 0").count() == 0
        if name == "benchmark_decontamination":
            items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            leaks = decontamination.find_leaks(docs, items).where("contaminated").collect()
            gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept[name].collect()}
            assert gone == {r["doc_id"] for r in leaks}
        if name == "secret_scans":
            assert kept[name].count() == docs.count()
        docs = kept[name]
    assert kept["best_fit_packing"].where("length > 2048").count() == 0
    ids = {r["doc_id"] for r in kept["best_fit_packing"].collect()}
    assert ids == {r["doc_id"] for r in kept["secret_scans"].collect()}


def test_run_gives_the_rows_of_the_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert 0 < len({r["doc_id"] for r in rows}) <= len(table(SMALL, "documents", "doc_id"))


def test_empty_tables(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame(
        [(1, f"some words {TOKEN}", "en", "a", 5, "k", 1), (1, f"some words {TOKEN}", "en", "a", 5, "k", 1), (None, None, None, None, None, None, None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, tie int",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs2 = stage(spark, docs, SMALL)
        assert docs2.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="needs the tables")
def test_entry_runs_without_the_subpackage(tmp_path):
    import subprocess

    script = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('cohortloom.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
