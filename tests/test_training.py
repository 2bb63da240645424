"""Training rows of large tables are dealt to tasks; small tables stay as they lie."""

from pyspark.sql import functions as F

from cohortloom.operators import training as tr


def sizes(rows):
    return sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())


def test_a_large_table_in_one_partition_is_dealt_evenly(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 1).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 7).alias("a"))
    assert tr.spread(rows) is rows
    monkeypatch.setattr(tr, "ROWS_PER_TASK", 100)
    dealt = tr.spread(rows)
    assert len(sizes(dealt)) == 11 and max(sizes(dealt)) <= 100
    assert sorted(dealt.collect()) == sorted(rows.collect())


def test_selection_fits_dealt_rows(spark, monkeypatch):
    rows = spark.range(0, 600, 1, 1).select((F.col("id") % 2).alias("y"), (F.col("id") % 2).alias("a"), (F.col("id") % 7).alias("b"))
    monkeypatch.setattr(tr, "ROWS_PER_TASK", 50)
    asked = []
    kept = tr.spread
    monkeypatch.setattr(tr, "spread", lambda df: asked.append(kept(df)) or asked[0])
    names, _ = tr.select_features(rows, ["a", "b"], "y", min_keep=1, params={"maxIter": 1, "maxDepth": 1})
    assert names == ["a"] and len(sizes(asked[0])) == 13
