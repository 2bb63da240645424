"""Metrics, counts, summaries, ranks, buckets, cohort tables and chart data."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortloom.catalog.features import SQL_STATUS_LABEL
from cohortloom.operators.quantiles import quantiles
from cohortloom.catalog.registry import as_long, query, rounded, table
from cohortloom.functions.nested import label_from_status
from cohortloom.operators import cohort as h
from cohortloom.operators import columns as c
from cohortloom.operators import impute as i
from cohortloom.operators import metrics as m
from cohortloom.operators import profile as p
from cohortloom.operators import ranking as r


def scored_documents(spark, sf):
    """Labelled documents with a score in 0..1 (many ties) and a prediction."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    score = F.least(F.floor(F.col("n_chars") / 100), F.lit(40)) / 40.0
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select("doc_id", "lang", "quality", "toxic", score.alias("score"))
        .withColumn("prediction", F.when(F.col("score") >= 0.25, 1).otherwise(0))
    )


_SQL_SCORED = """
    WITH d AS (SELECT doc_id, lang, quality, toxic, least(floor(n_chars / 100), 40) / 40.0 AS score
               FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT *, CASE WHEN score >= 0.25 THEN 1 ELSE 0 END AS prediction FROM d)"""


def _sql_metrics(keys: str = "") -> str:
    select, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""
    , k AS (SELECT {select}count(*) FILTER (quality = 1 AND prediction = 1) AS tp,
        count(*) FILTER (quality = 0 AND prediction = 1) AS fp,
        count(*) FILTER (quality = 1 AND prediction = 0) AS fn,
        count(*) FILTER (quality = 0 AND prediction = 0) AS tn FROM s {group})
    SELECT {select}round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
      round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


_METRIC_NAMES = ["accuracy", "precision", "recall", "f1"]


@query("binary_metrics", _SQL_SCORED + _sql_metrics() + " FROM k")
def binary_metrics(spark, sf):
    found = m.binary_metrics(scored_documents(spark, sf), "quality", "prediction")
    return found.select(*[rounded(x, 6).alias(x) for x in _METRIC_NAMES])


@query("binary_metrics_by_language", _SQL_SCORED + _sql_metrics("lang") + " FROM k")
def binary_metrics_by_language(spark, sf):
    found = m.binary_metrics(scored_documents(spark, sf), "quality", "prediction", ["lang"])
    return found.select("lang", *[rounded(x, 6).alias(x) for x in _METRIC_NAMES])


def _sql_auc(table_name: str, label: str, score: str) -> str:
    return f"""
    (WITH g AS (SELECT {score} AS sc, count(*) FILTER ({label} = 1) AS pos,
          count(*) FILTER ({label} = 0) AS neg FROM {table_name} GROUP BY 1),
     w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0) AS below FROM g)
     SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) FROM w)"""


@query("roc_auc", _SQL_SCORED + f" SELECT {_sql_auc('s', 'quality', 'score')} AS roc_auc")
def roc_auc(spark, sf):
    found = m.roc_auc(scored_documents(spark, sf), "quality", "score")
    return found.select(rounded("roc_auc", 6).alias("roc_auc"))


@query(
    "roc_auc_many_scores",
    """WITH l AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END AS y,
           l_extendedprice * (1 - l_discount) AS sc FROM lineitem)
    SELECT """
    + _sql_auc("l", "y", "round(sc, 2)").replace("AS sc,", "AS sc,")
    + " AS roc_auc",
)
def roc_auc_many_scores(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("y"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("score"),
    )
    return m.roc_auc(lines, "y", "score").select(rounded("roc_auc", 6).alias("roc_auc"))


@query(
    "all_metrics",
    _SQL_SCORED + _sql_metrics() + f", {_sql_auc('s', 'quality', 'score')} AS roc_auc FROM k",
)
def all_metrics(spark, sf):
    found = m.evaluate_scores(scored_documents(spark, sf), "quality", "score", "prediction")
    return found.select(*[rounded(x, 6).alias(x) for x in [*_METRIC_NAMES, "roc_auc"]])


_RUN_METRICS = ["value", "k"]


def event_runs(spark, sf):
    """Every event as one run of its type, with two measured numbers."""
    return table(spark, sf, "events").select(
        "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )


_SQL_RUNS = """
    WITH e AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
               FROM events),
    g AS (SELECT event_type, avg(value) AS value_mean, avg(k) AS k_mean,
            stddev_samp(value) AS value_std, stddev_samp(k) AS k_std FROM e GROUP BY 1),
    u AS (SELECT event_type, 'value' AS metric_name, value_mean AS mean, value_std AS std FROM g
          UNION ALL SELECT event_type, 'k', k_mean, k_std FROM g)"""


@query(
    "run_summaries",
    _SQL_RUNS
    + """ SELECT event_type, round(value_mean, 4) AS value_mean, round(k_mean, 4) AS k_mean,
      round(value_std, 4) AS value_std, round(k_std, 4) AS k_std FROM g""",
)
def run_summaries(spark, sf):
    found = m.summarise_runs(event_runs(spark, sf), ["event_type"], _RUN_METRICS)
    return found.select("event_type", *[rounded(x).alias(x) for x in found.columns[1:]])


@query(
    "long_results",
    _SQL_RUNS
    + " SELECT event_type, metric_name, round(mean, 4) AS mean, round(std, 4) AS std FROM u",
)
def long_results(spark, sf):
    wide = m.summarise_runs(event_runs(spark, sf), ["event_type"], _RUN_METRICS)
    found = m.to_long(wide, ["event_type"], _RUN_METRICS)
    return found.withColumns({x: rounded(x) for x in ("mean", "std")})


def _ordered_results(spark, sf):
    wide = m.summarise_runs(event_runs(spark, sf), ["event_type"], _RUN_METRICS)
    return m.to_long(wide, ["event_type"], _RUN_METRICS).withColumn("seq", F.ascii("event_type"))


@query(
    "best_per_metric",
    _SQL_RUNS
    + """ SELECT metric_name, event_type, round(mean, 4) AS mean, round(std, 4) AS std FROM u
    QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY mean DESC, ascii(event_type)) = 1""",
)
def best_per_metric(spark, sf):
    found = m.best_per_metric(_ordered_results(spark, sf), metrics=_RUN_METRICS)
    return found.withColumns({x: rounded(x) for x in ("mean", "std")})


@query(
    "best_configuration",
    _SQL_RUNS
    + """ SELECT metric_name, event_type, round(mean, 4) AS mean, round(std, 4) AS std FROM u
    WHERE metric_name = 'value' ORDER BY u.mean DESC, ascii(event_type) LIMIT 1""",
)
def best_configuration(spark, sf):
    found = m.best_config(_ordered_results(spark, sf), "value")
    return found.withColumns({x: rounded(x) for x in ("mean", "std")})


_SQL_THRESHOLDS = """
    , t AS (SELECT i, 0.1::DOUBLE + 0.05::DOUBLE * i AS threshold FROM unnest(range(18)) AS u(i)),
    f AS (SELECT threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp,
            count(*) FILTER (score >= threshold AND quality = 0) AS fp,
            count(*) FILTER (quality = 1) AS pos FROM s, t GROUP BY 1),
    q AS (SELECT threshold, coalesce(2 * tp / nullif(tp + fp + pos, 0), 0) AS f1 FROM f)"""


@query(
    "threshold_scores",
    _SQL_SCORED
    + _SQL_THRESHOLDS
    + " SELECT round(threshold, 2) AS threshold, round(f1, 6) AS f1 FROM q",
)
def threshold_scores(spark, sf):
    found = m.threshold_scores(scored_documents(spark, sf), "score", "quality")
    return found.select(rounded("threshold", 2).alias("threshold"), rounded("f1", 6).alias("f1"))


@query(
    "best_threshold",
    _SQL_SCORED
    + _SQL_THRESHOLDS
    + """ SELECT round(threshold, 2) AS threshold, round(f1, 6) AS f1 FROM q
    ORDER BY q.f1 DESC, q.threshold LIMIT 1""",
)
def best_threshold(spark, sf):
    found = m.best_threshold(scored_documents(spark, sf), "score", "quality")
    return found.select(rounded("threshold", 2).alias("threshold"), rounded("f1", 6).alias("f1"))


@query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return p.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "value_counts_for_keys",
    """
    SELECT o_orderstatus, coalesce(n, 0) AS n
    FROM (VALUES ('P'), ('O'), ('X')) AS k(o_orderstatus)
    LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) USING (o_orderstatus)""",
)
def value_counts_for_keys(spark, sf):
    return p.value_counts(table(spark, sf, "orders"), "o_orderstatus", ["P", "O", "X"])


def _orders_with_status(spark, sf):
    return table(spark, sf, "orders").withColumn(
        "label", label_from_status(F.col("o_orderstatus"), ["F"], ["P"])
    )


@query(
    "ongoing_check",
    f"""
    SELECT count(*) FILTER (o_orderstatus IN ('O', 'P')) AS ongoing,
      count(*) FILTER (o_orderstatus IN ('O', 'P') AND {SQL_STATUS_LABEL} IS NOT NULL) AS ongoing_labelled,
      count(*) FILTER (o_orderstatus IN ('O', 'P') AND {SQL_STATUS_LABEL} IS NOT NULL) = 0 AS passed
    FROM orders""",
)
def ongoing_check(spark, sf):
    return p.check_no_ongoing(_orders_with_status(spark, sf), "o_orderstatus", "label", ["O", "P"])


@query(
    "ongoing_left_over",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1",
)
def ongoing_left_over(spark, sf):
    return p.status_breakdown(table(spark, sf, "orders"), "o_orderstatus", ["O", "P"])


@query(
    "summary_statistics",
    """
    SELECT round(min(l_extendedprice), 4) AS min, round(median(l_extendedprice), 4) AS median,
      round(max(l_extendedprice), 4) AS max, round(avg(l_extendedprice), 4) AS mean,
      round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem""",
)
def summary_statistics(spark, sf):
    found = p.summary(table(spark, sf, "lineitem"), "l_extendedprice")
    return found.select(*[rounded(x).alias(x) for x in found.columns])


@query(
    "feature_totals",
    """
    SELECT 'l_quantity' AS feature, round(sum(l_quantity), 2) AS total,
      round(avg(l_quantity), 6) AS mean FROM lineitem
    UNION ALL SELECT 'l_tax', round(sum(l_tax), 2), round(avg(l_tax), 6) FROM lineitem
    UNION ALL SELECT 'l_linenumber', sum(l_linenumber), round(avg(l_linenumber), 6) FROM lineitem""",
)
def feature_totals(spark, sf):
    found = p.feature_totals(table(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_linenumber"])
    return found.select("feature", rounded("total", 2).alias("total"), rounded("mean", 6).alias("mean"))


@query(
    "histogram",
    """
    WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    n AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 50) + 1, 50) AS INTEGER) AS bin
          FROM orders, b),
    c AS (SELECT bin, count(*) AS n FROM n GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + (i - 1) * (hi - lo) / 50, 2) AS from_value,
      round(lo + i * (hi - lo) / 50, 2) AS to_value, coalesce(n, 0) AS n
    FROM unnest(range(1, 51)) AS u(i), b LEFT JOIN c ON c.bin = i""",
)
def histogram(spark, sf):
    found = p.histogram(table(spark, sf, "orders"), "o_totalprice")
    return found.withColumns({x: rounded(x, 2) for x in ("from_value", "to_value")})


_SQL_RANK = "row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)"
_SQL_CUTS = "SELECT quantile_cont(o_totalprice, 0.7) AS hi, quantile_cont(o_totalprice, 0.3) AS lo FROM orders"
_SQL_BUCKET = "CASE WHEN o_totalprice >= hi THEN 'LOW' WHEN o_totalprice <= lo THEN 'HIGH' ELSE 'MEDIUM' END"


@query("global_rank", f"SELECT o_orderkey, {_SQL_RANK} AS rank FROM orders")
def global_rank(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return r.rank_desc(orders, "o_totalprice", "o_orderkey").select("o_orderkey", "rank")


@query(
    "rank_with_ties",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER
      (ORDER BY l_returnflag DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank
    FROM lineitem""",
)
def rank_with_ties(spark, sf):
    """A third of all rows share each leading key; the last keys spread them."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf, "lineitem").select("l_returnflag", *keys)
    order = [F.col("l_returnflag").desc(), *[F.col(k).asc() for k in keys]]
    return r.with_row_number(lines, order, "rank").drop("l_returnflag")


@query(
    "risk_buckets",
    f"WITH c AS ({_SQL_CUTS}) SELECT o_orderkey, {_SQL_BUCKET} AS risk_bucket FROM orders, c",
)
def risk_buckets(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return r.risk_buckets(orders, "o_totalprice").select("o_orderkey", "risk_bucket")


@query(
    "bucket_info",
    f"""
    WITH c AS ({_SQL_CUTS}), b AS (SELECT hi, lo, {_SQL_BUCKET} AS risk_bucket FROM orders, c)
    SELECT round(any_value(hi), 4) AS low_threshold, round(any_value(lo), 4) AS high_threshold,
      count(*) FILTER (risk_bucket = 'LOW') AS low_count,
      count(*) FILTER (risk_bucket = 'MEDIUM') AS medium_count,
      count(*) FILTER (risk_bucket = 'HIGH') AS high_count FROM b""",
)
def bucket_info(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    cuts = r.bucket_thresholds(orders, "o_totalprice")
    found = r.bucket_info(r.risk_buckets(orders, "o_totalprice", cuts), cuts)
    return found.withColumns({x: rounded(x) for x in ("low_threshold", "high_threshold")})


@query(
    "top_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return r.top_n(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 25)


@query(
    "top_rows_ranked",
    f"""
    SELECT CAST({_SQL_RANK} AS INTEGER) AS rank, o_orderkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)
def top_rows_ranked(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return r.with_rank(orders, order, 20)


def status_orders(spark, sf):
    """Orders under cohort names: status, flag by priority, text, probability."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("nct_id"),
        F.when(F.col("o_orderstatus") == "O", "RECRUITING")
        .when(F.col("o_orderstatus") == "P", "ACTIVE_NOT_RECRUITING")
        .otherwise("COMPLETED")
        .alias("overall_status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("is_nsclc"),
        F.concat(F.lit("Order "), "o_orderpriority").alias("condition_text"),
        F.concat(F.lit("A sponsor with a long name, number "), "o_custkey").alias("lead_sponsor_name"),
        F.col("o_custkey").alias("number_of_facilities"),
        F.col("o_orderkey").alias("enrollment_planned_num"),
        (F.col("o_totalprice") / 500000).alias("p_completion"),
        (F.col("o_totalprice") / 1000).alias("pca_emb_0"),
        F.month("o_orderdate").alias("month"),
    )


_SQL_COHORT = """
    WITH c AS (SELECT o_orderkey AS nct_id,
        CASE o_orderstatus WHEN 'O' THEN 'RECRUITING' ELSE 'ACTIVE_NOT_RECRUITING' END AS overall_status,
        'A sponsor with a long name, number ' || o_custkey AS lead_sponsor_name,
        o_custkey AS number_of_facilities, o_totalprice / 500000 AS p,
        month(o_orderdate) AS month
      FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
    q AS (SELECT quantile_cont(p, 0.7) AS hi, quantile_cont(p, 0.3) AS lo FROM c),
    s AS (SELECT c.*, row_number() OVER (ORDER BY p DESC, nct_id) AS rank_nsclc,
            CASE WHEN p >= hi THEN 'LOW' WHEN p <= lo THEN 'HIGH' ELSE 'MEDIUM' END AS risk_bucket
          FROM c, q)"""


@query("cohort_by_flag", _SQL_COHORT + " SELECT nct_id, overall_status FROM c")
def cohort_by_flag(spark, sf):
    return h.filter_cohort(status_orders(spark, sf)).select("nct_id", "overall_status")


@query("cohort_by_keywords", _SQL_COHORT + " SELECT nct_id, overall_status FROM c")
def cohort_by_keywords(spark, sf):
    orders = status_orders(spark, sf).drop("is_nsclc")
    kept = h.filter_cohort(orders, keywords=["1-urgent", "ORDER 2-"])
    return kept.select("nct_id", "overall_status")


@query("picked_source", "SELECT o_orderkey AS nct_id FROM orders")
def picked_source(spark, sf):
    """The first table lacks the column, the second has no ongoing row, the third has."""
    orders = status_orders(spark, sf)
    done = orders.filter(F.col("overall_status") == "COMPLETED")
    candidates = [table(spark, sf, "nation"), done, orders]
    return h.pick_source(candidates, h.is_ongoing(), done).select("nct_id")


def scored_orders(spark, sf):
    cohort = h.filter_cohort(status_orders(spark, sf))
    return h.scored_table(cohort, ["month", "pca_emb_0"])


@query(
    "scored_table",
    _SQL_COHORT
    + """ SELECT nct_id, CAST(month AS INTEGER) AS month, overall_status, lead_sponsor_name,
      nct_id AS enrollment_planned_num, number_of_facilities, p AS p_completion, rank_nsclc,
      risk_bucket FROM s""",
)
def scored_table(spark, sf):
    return scored_orders(spark, sf)


@query(
    "critical_columns",
    _SQL_COHORT
    + """
    SELECT n AS "column", n <> 'phase_simple' AS present,
      CASE WHEN n <> 'phase_simple' THEN (SELECT count(*) FROM s) END AS filled
    FROM unnest(['nct_id', 'overall_status', 'phase_simple', 'p_completion', 'rank_nsclc',
                 'risk_bucket']) AS u(n)""",
)
def critical_columns(spark, sf):
    """Which critical columns the scored table has, and how many rows fill them."""
    scored = scored_orders(spark, sf)
    missing = i.missing_profile(scored).select("column", "missing")
    rows = scored.agg(F.count("*").alias("rows")).scalar()
    return c.check_columns(scored).join(missing, "column", "left").select(
        "column", "present", (rows - F.col("missing")).alias("filled")
    )


@query(
    "chart_distribution",
    _SQL_COHORT
    + """
    , b AS (SELECT min(p) AS lo, max(p) AS hi FROM s),
    n AS (SELECT CAST(least(floor((p - lo) / (hi - lo) * 50) + 1, 50) AS INTEGER) AS bin FROM s, b),
    g AS (SELECT bin, count(*) AS n FROM n GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n
    FROM unnest(range(1, 51)) AS u(i) LEFT JOIN g ON g.bin = i""",
)
def chart_distribution(spark, sf):
    return h.chart_data(scored_orders(spark, sf), "distribution").select("bin", "n")


@query("chart_buckets", _SQL_COHORT + " SELECT risk_bucket, count(*) AS n FROM s GROUP BY 1")
def chart_buckets(spark, sf):
    return h.chart_data(scored_orders(spark, sf), "buckets")


@query(
    "chart_top",
    _SQL_COHORT
    + """ SELECT nct_id, left(lead_sponsor_name, 30) AS lead_sponsor_name, rank_nsclc,
      p AS p_completion, risk_bucket FROM s WHERE rank_nsclc <= 25""",
)
def chart_top(spark, sf):
    return h.chart_data(scored_orders(spark, sf), "top")


@query(
    "chart_facilities",
    _SQL_COHORT
    + " SELECT number_of_facilities, p AS p_completion, risk_bucket FROM s",
)
def chart_facilities(spark, sf):
    return h.chart_data(scored_orders(spark, sf), "facilities")


@query(
    "chart_enrollment",
    _SQL_COHORT
    + " SELECT nct_id AS enrollment_planned_num, p AS p_completion, risk_bucket FROM s",
)
def chart_enrollment(spark, sf):
    return h.chart_data(scored_orders(spark, sf), "enrollment")


@query(
    "rank_counts_by_month",
    _SQL_COHORT
    + """ SELECT month, count(*) AS n, CAST(min(rank_nsclc) AS BIGINT) AS best FROM s GROUP BY 1""",
)
def rank_counts_by_month(spark, sf):
    found = scored_orders(spark, sf).groupBy(as_long("month").alias("month"))
    return found.agg(F.count("*").alias("n"), F.min("rank_nsclc").alias("best"))


_ODD_NUMBERS = """
    SELECT CASE WHEN o_orderkey % 10 < 2 THEN CAST('-inf' AS DOUBLE) WHEN o_orderkey % 10 < 4
      THEN CAST('inf' AS DOUBLE) WHEN o_orderkey % 10 = 4 THEN NULL ELSE 5.0 END AS x FROM orders"""


@query(
    "quantiles_with_infinities",
    f"""
    SELECT quantile_disc(x, 0.05) = CAST('-inf' AS DOUBLE) AS low_is_infinite, quantile_disc(x, 0.5) AS middle,
      quantile_disc(x, 0.95) = CAST('inf' AS DOUBLE) AS high_is_infinite, CAST(0 AS BIGINT) AS from_nulls
    FROM ({_ODD_NUMBERS})""",
)
def quantiles_with_infinities(spark, sf):
    """Infinities at both ends, nulls, and one value in the middle of almost half of all rows."""
    rest = F.col("o_orderkey") % 10
    x = (
        F.when(rest < 2, float("-inf")).when(rest < 4, float("inf"))
        .when(rest > 4, 5.0).alias("x")
    )
    rows = table(spark, sf, "orders").select(x, F.lit(None).cast("double").alias("nothing"))
    found = quantiles(rows, ["x", "nothing"], [0.05, 0.5, 0.95])
    low, middle, high = found["x"].values()
    values = sum(v is not None for v in found["nothing"].values())
    return spark.createDataFrame(
        [(low == float("-inf"), middle, high == float("inf"), values)],
        "low_is_infinite boolean, middle double, high_is_infinite boolean, from_nulls bigint",
    )


class _FixedLinear:
    """A model whose probability SQL can compute, too."""

    def transform(self, df):
        p = 1 / (1 + F.exp(-(F.col("month") - 6) / 4 - F.col("unknown")))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


@query(
    "scored_cohort_end_to_end",
    """
    WITH o AS (SELECT o_orderkey // 2 AS nct_id, month(o_orderdate) AS month, o_orderkey AS enrollment_planned_num,
        CASE o_orderstatus WHEN 'O' THEN 'RECRUITING' WHEN 'F' THEN 'COMPLETED'
          ELSE 'ENROLLING_BY_INVITATION' END AS overall_status, o_orderkey % 3 = 0 AS is_nsclc FROM orders),
    c AS (SELECT *, 1 / (1 + exp(-(month - 6) / 4.0)) AS p FROM o WHERE is_nsclc AND overall_status <> 'COMPLETED'),
    t AS (SELECT quantile_cont(p, 0.7) AS low, quantile_cont(p, 0.3) AS high FROM c)
    SELECT nct_id, CAST(month AS INTEGER) AS month, overall_status, enrollment_planned_num,
      round(p, 6) AS p_completion, CASE WHEN p >= low - 1e-12 THEN 'LOW' WHEN p <= high + 1e-12 THEN 'HIGH'
      ELSE 'MEDIUM' END AS risk_bucket FROM c, t""",
)
def scored_cohort_end_to_end(spark, sf):
    """Source choice, filter, alignment, scoring and buckets; two rows may share an id."""
    from cohortloom.plans.scoring import score_cohort

    status = F.when(F.col("o_orderstatus") == "O", "RECRUITING").when(F.col("o_orderstatus") == "F", "COMPLETED")
    orders = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 2).cast("bigint").alias("nct_id"), F.month("o_orderdate").alias("month"),
        F.col("o_orderkey").alias("enrollment_planned_num"),
        status.otherwise("ENROLLING_BY_INVITATION").alias("overall_status"),
        (F.col("o_orderkey") % 3 == 0).cast("int").alias("is_nsclc"),
    )
    done = orders.filter(F.col("overall_status") == "COMPLETED")
    metadata = {"feature_names": ["month", "unknown"]}
    scored = score_cohort([done, orders], done, _FixedLinear(), metadata)
    return scored.select(
        "nct_id", "month", "overall_status", "enrollment_planned_num",
        rounded("p_completion", 6).alias("p_completion"), "risk_bucket",
    )
