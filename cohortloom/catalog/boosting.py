"""Boosting by histograms, with every cut and gain computed again in SQL.

The label is told by the size of a part, turned over for a fifth of the parts, so no cut is pure.
"""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query, rounded, table
from cohortloom.operators import boosting as b
from cohortloom.operators import training as tr
from cohortloom.operators.sampling import assign_split

FEATURES = ["price", "remainder", "size"]
PARAMS = {"maxIter": 1, "maxDepth": 2, "stepSize": 0.3}


def noisy_parts(spark, sf):
    """Some sizes are missing; the label follows size, price where size is missing, and noise."""
    key = F.col("p_partkey").cast("bigint")
    price = F.floor(F.col("p_retailprice") / 25).cast("double")
    told = F.when(key % 7 == 0, price > 60).otherwise(F.col("p_size") > 25)
    return table(spark, sf, "part").select(
        "p_partkey", price.alias("price"), (key * 7919 % 101).cast("double").alias("remainder"),
        F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")).alias("size"),
        (told != (key * 31 % 10 < 2)).cast("double").alias("label"),
    )


def _sql_level(level: int) -> str:
    """Best cut of every node of a level, and the rows of the next one."""
    return f"""
    s{level} AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM x JOIN r{level} USING (p_partkey) GROUP BY ALL),
    c{level} AS (SELECT node, f, v, lead(v) OVER w AS above, sum(CASE WHEN v IS NULL THEN 0 ELSE g END) OVER w AS gl,
        sum(CASE WHEN v IS NULL THEN 0 ELSE h END) OVER w AS hl,
        sum(g) OVER (PARTITION BY node, f) AS ga, sum(h) OVER (PARTITION BY node, f) AS ha, sum(n) OVER (PARTITION BY node, f) AS na,
        coalesce(sum(g) FILTER (v IS NULL) OVER (PARTITION BY node, f), 0) AS gm,
        coalesce(sum(h) FILTER (v IS NULL) OVER (PARTITION BY node, f), 0) AS hm
      FROM s{level} WINDOW w AS (PARTITION BY node, f ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING)),
    k{level} AS (SELECT node, f, v, above, m, na, ga, ha, gl + CASE WHEN m THEN gm ELSE 0 END AS gl,
        hl + CASE WHEN m THEN hm ELSE 0 END AS hl FROM c{level}, (SELECT unnest([TRUE, FALSE]) AS m) WHERE v IS NOT NULL),
    g{level} AS (SELECT *, round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), {b.GAIN_DECIMALS}) AS gain
      FROM k{level} WHERE hl >= 1 AND ha - hl >= 1),
    b{level} AS (SELECT * FROM g{level} WHERE gain > 0
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v, m DESC) = 1),
    r{level + 1} AS (SELECT p_partkey, 2 * node + CASE WHEN coalesce(x.v <= b{level}.v, b{level}.m) THEN 0 ELSE 1 END AS node, g, h
      FROM r{level} JOIN b{level} USING (node) JOIN x USING (p_partkey, f))"""


_SQL_SPLITS = f"""
    WITH p AS (SELECT p_partkey, floor(p_retailprice / 25) AS price, p_partkey * 7919 % 101 AS remainder,
        CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS size,
        CASE WHEN (CASE WHEN p_partkey % 7 = 0 THEN floor(p_retailprice / 25) > 60 ELSE p_size > 25 END)
          <> (p_partkey * 31 % 10 < 2) THEN 1 ELSE 0 END AS label FROM part),
    x AS (SELECT p_partkey, unnest({FEATURES}) AS f,
        unnest([CAST(price AS DOUBLE), CAST(remainder AS DOUBLE), CAST(size AS DOUBLE)]) AS v FROM p),
    r0 AS (SELECT p_partkey, 1 AS node, 0.5 - CAST(label AS DOUBLE) AS g, CAST(0.25 AS DOUBLE) AS h FROM p),
    {_sql_level(0)}, {_sql_level(1)},
    splits AS (SELECT node, f AS feature, CASE WHEN above IS NULL THEN CAST('inf' AS DOUBLE) ELSE v END AS cut,
        m AS missing_left, gain, CAST(na AS BIGINT) AS n_rows FROM b0 UNION ALL
      SELECT node, f, CASE WHEN above IS NULL THEN CAST('inf' AS DOUBLE) ELSE v END, m, gain, CAST(na AS BIGINT) FROM b1)"""


def _first_tree(spark, sf):
    rows = b.with_missing(noisy_parts(spark, sf), FEATURES)
    return b.GainBoosting(idCol="p_partkey", **PARAMS).fit(rows)


@query(
    "first_tree_splits",
    _SQL_SPLITS + " SELECT CAST(node AS INT) AS node, feature, cut, missing_left, round(gain, 6) AS gain, n_rows FROM splits",
)
def first_tree_splits(spark, sf):
    """Cuts, gains and sides of missing values of a tree's first two levels."""
    found = b.split_table(_first_tree(spark, sf), spark, FEATURES)
    return found.select("node", "feature", "cut", "missing_left", F.round("gain", 6).alias("gain"), F.col("rows").alias("n_rows"))


@query(
    "gain_importances",
    _SQL_SPLITS
    + f""",
    a AS (SELECT f AS feature, coalesce(avg(gain), 0) AS gain FROM (SELECT unnest({FEATURES}) AS f) LEFT JOIN splits ON feature = f GROUP BY f)
    SELECT feature, round(gain / sum(gain) OVER (), 4) AS importance, gain > avg(gain) OVER () AS kept FROM a""",
)
def gain_importances(spark, sf):
    """Features selected by average gain, out of those of the first tree."""
    _, found = tr.select_features(noisy_parts(spark, sf), FEATURES, "label", min_keep=1, params=PARAMS, family="gain_boosted")
    return found.select("feature", rounded("importance").alias("importance"), "kept")


@query("gain_boosted_results")
def gain_boosted_results(spark, sf):
    """The family in a whole experiment: split, class weights left out, five metrics."""
    parts = noisy_parts(spark, sf).withColumn("size", F.nanvl("size", F.lit(-1.0)))
    split = assign_split(parts, "p_partkey", "label")
    config = tr.Config("gain_boosted", params={"maxIter": 3, "maxDepth": 3, "stepSize": 0.3})
    found = tr.evaluate(split, FEATURES, [config], "p_partkey", "label", runs=1)
    return found.select("model_name", "metric_name", rounded("mean").alias("mean"))
