"""Splits, folds, resampling, weights and samples.

A draw is the first 13 hex digits of an MD5, so the same rows can be named in SQL.
"""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import as_long, query, rounded, table
from cohortloom.operators import sampling as s


def sql_draw(id_col: str, seed: int = 42) -> str:
    return f"CAST('0x' || left(md5(CAST({id_col} AS VARCHAR) || ':{seed}'), 13) AS BIGINT)"


def _sql_split(stratum: str) -> str:
    """Held-out parts are the rows with the smallest draws of each stratum.

    Per-stratum sizes follow the largest-remainder rule on the kept part.
    """
    return f"""
    WITH l AS (SELECT doc_id, quality, {stratum} AS g, {sql_draw("doc_id")} AS d FROM labels),
    c AS (SELECT g, count(*) AS n FROM l GROUP BY g),
    t AS (SELECT sum(n) AS total, CAST(sum(n) - ceil(sum(n) * 0.2) AS BIGINT) AS kept FROM c),
    k1 AS (SELECT g, n, kept, n * kept / total AS x, floor(n * kept / total) AS base FROM c, t),
    k2 AS (SELECT g, n, kept, base + CASE WHEN row_number() OVER (ORDER BY x - base DESC, g)
             <= kept - sum(base) OVER () THEN 1 ELSE 0 END AS keep FROM k1),
    v1 AS (SELECT g, n, keep, kept, CAST(kept - ceil(kept * 0.15) AS BIGINT) AS train_all FROM k2),
    v2 AS (SELECT *, keep * train_all / kept AS x, floor(keep * train_all / kept) AS base FROM v1),
    v3 AS (SELECT g, n, keep, base + CASE WHEN row_number() OVER (ORDER BY x - base DESC, g)
             <= train_all - sum(base) OVER () THEN 1 ELSE 0 END AS train FROM v2),
    r AS (SELECT doc_id, quality, g, row_number() OVER (PARTITION BY g ORDER BY d, doc_id) AS rn FROM l)
    , sp AS (SELECT doc_id, quality, CASE WHEN rn <= n - keep THEN 'test' WHEN rn <= n - train THEN 'validation'
      ELSE 'train' END AS split FROM r JOIN v3 USING (g))"""


@query("stratified_split", _sql_split("quality") + " SELECT doc_id, split FROM sp")
def stratified_split(spark, sf):
    return s.assign_split(table(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "split")


@query("plain_split", _sql_split("1") + " SELECT doc_id, split FROM sp")
def plain_split(spark, sf):
    labels = table(spark, sf, "labels")
    return s.assign_split(labels, "doc_id", "quality", stratify=False).select("doc_id", "split")


@query(
    "split_sizes",
    _sql_split("quality") + " SELECT quality, split, count(*) AS n FROM sp GROUP BY ALL",
)
def split_sizes(spark, sf):
    labels = s.assign_split(table(spark, sf, "labels"), "doc_id", "quality")
    return labels.groupBy("quality", "split").agg(F.count("*").alias("n"))


@query(
    "attached_split",
    _sql_split("quality")
    + " SELECT doc_id, split, n_chars FROM sp JOIN documents USING (doc_id)",
)
def attached_split(spark, sf):
    splits = s.assign_split(table(spark, sf, "labels"), "doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return s.attach_split(docs, splits, "doc_id").select("doc_id", "split", "n_chars")


@query(
    "stratified_folds",
    f"""
    SELECT o_orderkey, CAST(floor((rn * 5 - 1) / n) AS INTEGER) AS fold
    FROM (SELECT o_orderkey,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_draw("o_orderkey")}, o_orderkey) AS rn,
        count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def stratified_folds(spark, sf):
    orders = table(spark, sf, "orders")
    return s.assign_folds(orders, "o_orderkey", "o_orderstatus").select("o_orderkey", "fold")


@query(
    "folds_by_customer",
    f"""
    SELECT o_orderkey, CAST(floor((rn * 3 - 1) / n) AS INTEGER) AS fold
    FROM (SELECT o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY {sql_draw("o_orderkey")}, o_orderkey) AS rn,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""",
)
def folds_by_customer(spark, sf):
    """Folds over very many classes: every customer is one."""
    orders = table(spark, sf, "orders")
    return s.assign_folds(orders, "o_orderkey", "o_custkey", 3).select("o_orderkey", "fold")


@query(
    "weights_by_customer",
    """
    SELECT o_orderkey, round(count(*) OVER () * 1.0
      / ((SELECT count(DISTINCT o_custkey) FROM orders) * count(*) OVER (PARTITION BY o_custkey)), 6) AS weight
    FROM orders""",
)
def weights_by_customer(spark, sf):
    weighted = s.class_weights(table(spark, sf, "orders"), "o_custkey")
    return weighted.select("o_orderkey", rounded("weight", 6).alias("weight"))


def _sql_downsample(ratio: float) -> str:
    return f"""
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
    t AS (SELECT least(CAST(floor(min(n) * {ratio}) AS BIGINT), max(n)) AS target,
            arg_max(quality, n) AS majority FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_draw("doc_id")}, doc_id) AS rn
          FROM labels)
    SELECT doc_id, quality FROM r, t WHERE quality <> majority OR rn <= target"""


@query("downsampled_even", _sql_downsample(1.0))
def downsampled_even(spark, sf):
    return s.rebalance(table(spark, sf, "labels"), "quality", "doc_id", "downsample_balanced").select(
        "doc_id", "quality"
    )


@query("downsampled_half_more", _sql_downsample(1.5))
def downsampled_half_more(spark, sf):
    return s.rebalance(table(spark, sf, "labels"), "quality", "doc_id", "downsample_1_5").select(
        "doc_id", "quality"
    )


@query("downsampled_double", _sql_downsample(2.0))
def downsampled_double(spark, sf):
    return s.rebalance(table(spark, sf, "labels"), "quality", "doc_id", "partial_downsample").select(
        "doc_id", "quality"
    )


@query("not_resampled", "SELECT doc_id, quality FROM labels")
def not_resampled(spark, sf):
    return s.rebalance(table(spark, sf, "labels"), "quality", "doc_id", "class_weight").select(
        "doc_id", "quality"
    )


@query(
    "oversampled",
    f"""
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
    t AS (SELECT min(n) AS small, arg_min(quality, n) AS minority,
            CAST(floor(max(n) * 0.8) AS BIGINT) - min(n) AS extra FROM c),
    m AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS rn
          FROM labels, t WHERE quality = minority),
    p AS (SELECT {sql_draw("i")} % small + 1 AS rn FROM t, unnest(range(extra)) AS u(i))
    SELECT doc_id, quality FROM labels
    UNION ALL SELECT doc_id, quality FROM p JOIN m USING (rn)""",
)
def oversampled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return s.oversample(labels, "quality", "doc_id", 0.8)


@query(
    "class_weights",
    """
    SELECT o_orderkey, round(count(*) OVER () / (3.0 * count(*) OVER (PARTITION BY o_orderstatus)), 6)
      AS weight FROM orders""",
)
def class_weights(spark, sf):
    weighted = s.class_weights(table(spark, sf, "orders"), "o_orderstatus")
    return weighted.select("o_orderkey", rounded("weight", 6).alias("weight"))


@query(
    "sampled_rows",
    f"SELECT vec_id, label FROM embeddings ORDER BY {sql_draw('vec_id')}, vec_id LIMIT 200",
)
def sampled_rows(spark, sf):
    return s.sample_n(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 200)


@query("draws", f"SELECT l_partkey, l_suppkey, {sql_draw('l_orderkey', 7)} AS draw FROM lineitem")
def draws(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", as_long(s.draw(F.col("l_orderkey"), 7)).alias("draw")
    )
