"""The radial classifier: its map against plain similarities, and a refit with a closed form."""

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortloom.catalog.models import _SQL_PLANTED, _planted_results, _sql_told, planted_parts, sql_planted_split
from cohortloom.catalog.registry import query, rounded, table
from cohortloom.operators import training as tr
from cohortloom.operators.cohort import score
from cohortloom.operators.radial import RadialMap
from cohortloom.plans.experiments import run_experiments
from cohortloom.session import ensure_checkpoint_dir
from cohortloom.sources.models import load_model

SHOWN = 12


@query(
    "radial_similarities",
    f"""
    WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey * 7919 % 101 AS DOUBLE) AS b FROM part),
    s AS (SELECT p_partkey, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b FROM v),
    g AS (SELECT 1 / (2 * var_pop(x)) AS gamma FROM (SELECT a AS x FROM s UNION ALL SELECT b FROM s)),
    l AS (SELECT row_number() OVER (ORDER BY chance) - 1 AS landmark, a AS la, b AS lb FROM (
      SELECT *, CAST('0x' || left(md5(CAST(p_partkey AS VARCHAR) || ':42'), 13) AS BIGINT) AS chance FROM s ORDER BY chance LIMIT {SHOWN}))
    SELECT p_partkey, CAST(landmark AS BIGINT) AS landmark,
      round(exp(-gamma * ((a - la) * (a - la) + (b - lb) * (b - lb))), 4) + 0.0 AS similarity FROM s, l, g""",
)
def radial_similarities(spark, sf):
    """Inner products of every part's vector with those of the landmarks, which are the parts with the lowest draws."""
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey").cast("bigint") * 7919 % 101).cast("double").alias("b")
    )
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    model = RadialMap("scaled", "radial", landmarks=SHOWN, idCol="p_partkey").fit(scaled)
    marks = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in model.image(model.landmarks)])
    own = model.transform(scaled).select("p_partkey", vector_to_array("radial").alias("own"))
    products = F.transform(marks, lambda m: F.aggregate(F.zip_with("own", m, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    found = own.select("p_partkey", F.posexplode(products).alias("landmark", "similarity"))
    return found.select("p_partkey", F.col("landmark").cast("bigint").alias("landmark"), rounded("similarity").alias("similarity"))


@query("planted_radial_results", _sql_told("radial_svm"))
def planted_radial_results(spark, sf):
    return _planted_results(spark, sf, tr.Config("radial_svm"), ["large"])


@query(
    "refitted_svm_scores",
    f"""
    {sql_planted_split()},
    w AS (SELECT large, avg(p.target) AS share FROM sp JOIN p USING (p_partkey) WHERE split = 'train' GROUP BY large)
    SELECT p_partkey, round(share, 3) + 0.0 AS p_completion FROM p JOIN w USING (large)""",
)
def refitted_svm_scores(spark, sf):
    """The best model, a linear machine, refitted as a radial one on the train part, saved and loaded.

    With one feature of two values the logistic fit on its two margins ends at the shares of the label.
    """
    rows = planted_parts(spark, sf).select("p_partkey", "large", "target")
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    run_experiments(
        rows, [tr.Config("svm", params={"maxIter": 20})], path, runs=1, grids={}, select=False, id_col="p_partkey", label="target"
    )
    model, metadata = load_model(spark, path)
    assert isinstance(model, PipelineModel) and metadata["model_name"] == "svm"
    scored = score(rows.select("p_partkey", *metadata["feature_names"]), model)
    return scored.select("p_partkey", rounded("p_completion", 3).alias("p_completion"))
