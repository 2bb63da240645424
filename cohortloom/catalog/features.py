"""Column rules, imputation, coercion, scaling and vectors."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import as_long, query, rounded, table
from cohortloom.functions.nested import label_from_status
from cohortloom.operators import columns as c
from cohortloom.operators import impute as i
from cohortloom.operators import vectors as v

SQL_STATUS_LABEL = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 END"


def labelled_orders(spark, sf):
    """Orders under registry column names, with a leaking, a text and a constant column."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("nct_id"),
        label_from_status(F.lower("o_orderstatus"), ["F"], ["P"]).alias("label_feasible"),
        F.col("o_orderstatus").alias("overall_status"),
        F.col("o_orderdate").cast("string").alias("results_posted_date"),
        F.col("o_orderpriority").alias("condition_text"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("customer"),
        F.lit("INTERVENTIONAL").alias("study_kind"),
        F.lit(None).cast("double").alias("nothing"),
        (F.col("o_totalprice") / 1000).alias("pca_emb_0"),
    )


@query("label_from_status", f"SELECT o_orderkey, {SQL_STATUS_LABEL} AS label FROM orders")
def status_labels(spark, sf):
    label = label_from_status(F.lower("o_orderstatus"), ["F"], ["P"])
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


@query(
    "feature_view_tabular",
    f"""
    SELECT o_orderkey AS nct_id, {SQL_STATUS_LABEL} AS label_feasible, o_orderpriority AS priority,
      o_totalprice AS price, o_custkey AS customer, 'INTERVENTIONAL' AS study_kind,
      CAST(NULL AS DOUBLE) AS nothing
    FROM orders WHERE o_orderstatus IN ('F', 'P')""",
)
def feature_view_tabular(spark, sf):
    return c.feature_view(labelled_orders(spark, sf), "tabular")


@query(
    "feature_view_with_vectors",
    f"""
    SELECT o_orderkey AS nct_id, {SQL_STATUS_LABEL} AS label_feasible, o_orderpriority AS priority,
      o_totalprice AS price, o_custkey AS customer, o_totalprice / 1000 AS pca_emb_0
    FROM orders WHERE o_orderstatus IN ('F', 'P')""",
)
def feature_view_with_vectors(spark, sf):
    view = c.feature_view(labelled_orders(spark, sf), "tabular_plus_embeddings")
    return view.drop(*c.constant_columns(view))


@query(
    "constant_columns",
    f"""
    WITH o AS (SELECT o_orderkey AS nct_id, {SQL_STATUS_LABEL} AS label_feasible,
        o_orderpriority AS priority, 'INTERVENTIONAL' AS study_kind, CAST(NULL AS DOUBLE) AS nothing
      FROM orders)
    SELECT 'nct_id' AS name, count(DISTINCT nct_id) <= 1 AS constant FROM o
    UNION ALL SELECT 'label_feasible', count(DISTINCT label_feasible) <= 1 FROM o
    UNION ALL SELECT 'priority', count(DISTINCT priority) <= 1 FROM o
    UNION ALL SELECT 'study_kind', count(DISTINCT study_kind) <= 1 FROM o
    UNION ALL SELECT 'nothing', count(DISTINCT nothing) <= 1 FROM o""",
)
def constant_columns(spark, sf):
    names = ["nct_id", "label_feasible", "priority", "study_kind", "nothing"]
    found = c.constant_columns(labelled_orders(spark, sf), names)
    return spark.createDataFrame([(n, n in found) for n in names], "name string, constant boolean")


@query(
    "aligned_features",
    """
    SELECT o_orderkey AS nct_id, CAST(0 AS INTEGER) AS unknown_flag, o_totalprice AS price,
      CAST(0 AS INTEGER) AS has_us_sites FROM orders""",
)
def aligned_features(spark, sf):
    names = ["unknown_flag", "price", "has_us_sites"]
    return c.align_features(labelled_orders(spark, sf), names, keep=["nct_id"])


@query(
    "masked_columns",
    "SELECT o_orderkey AS nct_id, o_orderpriority AS priority, o_custkey AS customer FROM orders",
)
def masked_columns(spark, sf):
    """A feature mask, then the columns both frames share."""
    orders = labelled_orders(spark, sf)
    kept = {"nct_id", "priority", "customer", "price"}
    masked = c.apply_feature_mask(orders, [n in kept for n in orders.columns])
    return masked.select(*c.common_columns(masked, orders.drop("price")))


@query(
    "prefix_dropped",
    "SELECT n_nationkey, n_name FROM nation WHERE NOT starts_with(n_name, 'NATION_1')",
)
def prefix_dropped(spark, sf):
    """Columns dropped by prefix, rows left out by prefix."""
    nation = table(spark, sf, "nation")
    return c.exclude_prefix(c.drop_prefix(nation, "n_region"), "n_name", "NATION_1")


@query(
    "median_imputed",
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        CASE WHEN l_discount > 0 THEN l_quantity END AS quantity,
        CASE WHEN l_returnflag <> 'A' THEN l_tax END AS tax FROM lineitem),
    m AS (SELECT median(quantity) AS mq, median(tax) AS mt FROM l)
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
      round(coalesce(quantity, mq), 4) AS quantity, round(coalesce(tax, mt), 4) AS tax FROM l, m""",
)
def median_imputed(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("tax"),
    )
    filled = i.apply_impute(lines, i.fit_impute(lines, ["quantity", "tax"]))
    return filled.withColumns({n: rounded(n) for n in ("quantity", "tax")})


@query(
    "mode_imputed",
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS p,
                 CAST(NULL AS VARCHAR) AS none FROM orders),
    m AS (SELECT p AS top FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
    SELECT o_orderkey, coalesce(p, top) AS priority, '0' AS none FROM o, m""",
)
def mode_imputed(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("priority"),
        F.lit(None).cast("string").alias("none"),
    )
    return i.apply_impute(orders, i.fit_impute(orders, ["priority", "none"]))


@query(
    "numbers_from_text",
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS kind,
      CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS DOUBLE) AS high,
      CAST(CASE WHEN event_type = 'click' THEN 0 ELSE value END AS DOUBLE) AS value
    FROM events""",
)
def numbers_from_text(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("event_type").alias("kind"),
        (F.col("value") > 50).alias("high"),
        F.when(F.col("event_type") != "click", F.col("value")).alias("value"),
    )
    return i.coerce_numeric(events, ["k", "kind", "high", "value"])


@query(
    "category_codes",
    """
    SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS priority
    FROM orders""",
)
def category_codes(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority")
    )
    return i.coerce_numeric(orders, ["priority"], categoricals="index")


@query(
    "standard_scaled",
    """
    WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS dq,
                 avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS dp FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / dq, 4) + 0.0 AS quantity,
      round((l_extendedprice - mp) / dp, 4) + 0.0 AS price, CAST(0 AS DOUBLE) AS same FROM lineitem, s""",
)
def standard_scaled(spark, sf):
    return _scaled(spark, sf, "standard")


@query(
    "range_scaled",
    """
    WITH s AS (SELECT min(l_quantity) AS mq, max(l_quantity) - min(l_quantity) AS dq,
                 min(l_extendedprice) AS mp, max(l_extendedprice) - min(l_extendedprice) AS dp
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / dq, 4) + 0.0 AS quantity,
      round((l_extendedprice - mp) / dp, 4) + 0.0 AS price, CAST(0 AS DOUBLE) AS same FROM lineitem, s""",
)
def range_scaled(spark, sf):
    return _scaled(spark, sf, "minmax")


def _scaled(spark, sf, how):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.lit(7.0).alias("same"),
    )
    names = ["quantity", "price", "same"]
    scaled = i.apply_scale(lines, i.fit_scale(lines, names, how))
    return scaled.withColumns({n: rounded(n) for n in names})


@query(
    "missing_profile",
    """
    WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind,
                 CASE WHEN value < 10 THEN value END AS value FROM events)
    SELECT 'event_id' AS "column", count(*) - count(event_id) AS missing,
      round(1 - count(event_id) / count(*), 4) AS share FROM e
    UNION ALL SELECT 'kind', count(*) - count(kind), round(1 - count(kind) / count(*), 4) FROM e
    UNION ALL SELECT 'value', count(*) - count(value), round(1 - count(value) / count(*), 4) FROM e""",
)
def missing_profile(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.when(F.col("value") < 10, F.col("value")).alias("value"),
    )
    return i.missing_profile(events).withColumn("share", rounded("share"))


def gappy_vectors(spark, sf):
    """Embeddings of which one class is missing and one holds no number."""
    vectors = table(spark, sf, "embeddings")
    nans = F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    return vectors.select(
        "vec_id",
        F.when(F.col("label") == 0, None)
        .when(F.col("label") == 1, nans)
        .otherwise(F.col("embedding"))
        .alias("embedding"),
    )


@query("valid_vectors", "SELECT vec_id, label > 1 AS valid FROM embeddings")
def valid_vectors(spark, sf):
    return gappy_vectors(spark, sf).select("vec_id", v.valid_vector(F.col("embedding")).alias("valid"))


@query(
    "vector_columns",
    "SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS emb_{k}" for k in range(64))
    + " FROM (SELECT vec_id, CASE WHEN label <> 0 THEN embedding END AS embedding FROM embeddings)",
)
def vector_columns(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") != 0, F.col("embedding")).alias("embedding")
    )
    wide = c.expand_vector(vectors, "embedding", 64, "emb_")
    return wide.select("vec_id", *[F.col(n).cast("double").alias(n) for n in wide.columns[2:]])


@query(
    "standardised_vectors",
    """
    WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
                 generate_subscripts(embedding, 1) AS pos FROM embeddings),
    s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM e GROUP BY pos)
    SELECT vec_id, CAST(pos AS BIGINT) AS pos, round((x - m) / d, 3) + 0.0 AS scaled FROM e JOIN s USING (pos)""",
)
def standardised_vectors(spark, sf):
    scaled = v.standardise_vectors(table(spark, sf, "embeddings"), "embedding")
    return scaled.select("vec_id", F.posexplode("scaled").alias("pos", "x")).select(
        "vec_id", as_long(F.col("pos") + 1).alias("pos"), rounded("x", 3).alias("scaled")
    )


@query("vector_reduction_report")
def vector_reduction_report(spark, sf):
    vectors = gappy_vectors(spark, sf)
    return v.reduction_report(vectors, "embedding", v.fit_reduction(vectors, "embedding"))


@query(
    "reduced_vectors_kept",
    "SELECT vec_id, label > 1 AS reduced, TRUE AS enough, TRUE AS fewest FROM embeddings",
)
def reduced_vectors_kept(spark, sf):
    """Valid rows get components, others null; the variance kept is above 95 % and minimal."""
    vectors = gappy_vectors(spark, sf)
    reduction = v.fit_reduction(vectors, "embedding")
    kept = sum(reduction.variance[: reduction.kept])
    without_last = kept - reduction.variance[reduction.kept - 1]
    return v.apply_reduction(vectors, "embedding", reduction).select(
        "vec_id",
        F.col("pca").isNotNull().alias("reduced"),
        F.lit(kept > 0.95).alias("enough"),
        F.lit(without_last <= 0.95).alias("fewest"),
    )


@query(
    "reduction_of_pairs",
    """
    WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, count(*) AS n FROM lineitem)
    SELECT n AS valid_rows, CAST(0 AS BIGINT) AS missing_rows, 2 AS original_size,
      CASE WHEN (1 + r) / 2 > 0.95 THEN 1 ELSE 2 END AS reduced_size,
      CASE WHEN (1 + r) / 2 > 0.95 THEN 2.0 ELSE 1.0 END AS compression,
      round(CASE WHEN (1 + r) / 2 > 0.95 THEN (1 + r) / 2 ELSE 1.0 END, 6) AS variance_kept FROM c""",
)
def reduction_of_pairs(spark, sf):
    """Two standardised columns: the rotation's variances are one plus and minus their correlation."""
    pairs = table(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("pair")
    )
    report = v.reduction_report(pairs, "pair", v.fit_reduction(pairs, "pair"))
    return report.withColumn("variance_kept", rounded("variance_kept", 6))
