"""Training, scoring, attribution and audit."""

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.catalog.registry import query, rounded, table
from cohortloom.catalog.samples import _sql_split
from cohortloom.operators import attribution as a
from cohortloom.operators import training as tr
from cohortloom.operators.cohort import score
from cohortloom.operators.columns import expand_vector
from cohortloom.operators.kernel_attribution import kernel_attribution
from cohortloom.operators.sampling import assign_split
from cohortloom.session import ensure_checkpoint_dir
from cohortloom.sources.models import load_model, save_model

SIZE = 64
NAMES = [f"emb_{i}" for i in range(SIZE)]


def vector_rows(spark, sf):
    """Embeddings as columns, labelled 1 for the first three classes."""
    vectors = table(spark, sf, "embeddings").withColumn(
        "target", F.when(F.col("label") < 3, 1).otherwise(0)
    )
    return expand_vector(vectors.drop("label"), "embedding", SIZE, "emb_").drop("embedding")


def split_vectors(spark, sf):
    return assign_split(vector_rows(spark, sf), "vec_id", "target")


def _results(spark, sf, configs, runs=2, **options):
    found = tr.evaluate(
        split_vectors(spark, sf), NAMES, configs, "vec_id", "target", runs=runs, **options
    )
    return found.select(
        "model_name", "input_mode", "imbalance_strategy", "metric_name",
        rounded("mean").alias("mean"), rounded("std").alias("std"),
    )


@query("feature_importances")
def feature_importances(spark, sf):
    params = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8}
    _, importances = tr.select_features(vector_rows(spark, sf), NAMES, "target", params=params)
    return importances


@query("forest_results")
def forest_results(spark, sf):
    grid = {"forest": {"numTrees": [10, 20], "maxDepth": [5]}}
    configs = [tr.Config("forest", strategy=s) for s in ("class_weight", "downsample_1_5")]
    return _results(spark, sf, configs, grids=grid, folds=3)


@query("boosted_results")
def boosted_results(spark, sf):
    params = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1}
    configs = [
        tr.Config("boosted", strategy=s, params=dict(params))
        for s in ("class_weight", "downsample_balanced")
    ]
    return _results(spark, sf, configs)


@query("svm_results")
def svm_results(spark, sf):
    return _results(spark, sf, [tr.Config("svm", params={"maxIter": 20})])


@query("network_results")
def network_results(spark, sf):
    params = {"hidden": [16], "maxIter": 30}
    return _results(spark, sf, [tr.Config("network", strategy="oversample_0.8", params=params)])


@query("two_tower_results")
def two_tower_results(spark, sf):
    """The two-input network: vectors in one branch, two numbers of them again in the other."""
    rows = split_vectors(spark, sf)
    named = rows.select(
        "vec_id", "target", "split", (F.col("emb_0") + F.col("emb_1")).alias("sum"), (F.col("emb_0") * F.col("emb_1")).alias("product"),
        *[F.col(n).alias(f"{fv.PCA_PREFIX}{i}") for i, n in enumerate(NAMES)],
    )
    cols = [c for c in named.columns if c not in ("vec_id", "target", "split")]
    params = {"epochs": 6, "batchSize": 2048, "stepSize": 0.01}
    found = tr.evaluate(named, cols, [tr.Config("two_towers", "tabular_plus_embeddings", "oversample_0.8", params)], "vec_id", "target", runs=1)
    return found.select("model_name", "metric_name", rounded("mean").alias("mean"))


@query("saved_model_scores")
def saved_model_scores(spark, sf):
    """Refit, save, load, score every row; the file carries the feature order."""
    rows = split_vectors(spark, sf)
    config = tr.Config("forest", params={"numTrees": 10, "maxDepth": 4})
    model = tr.refit(rows.filter(F.col("split") == "train"), NAMES, config, "vec_id", "target")
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(model, {"model_name": "forest", "feature_names": NAMES, "random_state": 42}, path)
    loaded, metadata = load_model(spark, path)
    scored = score(rows.select("vec_id", *metadata["feature_names"]), loaded)
    return scored.select("vec_id", rounded("p_completion").alias("p_completion"))


_WEIGHTS = {"l_quantity": 0.5, "l_discount": -20.0, "l_tax": 3.0}
_SQL_PHI = """
    WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt FROM lineitem),
    p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax,
            0.5 * (l_quantity - mq) AS pq, -20 * (l_discount - md) AS pd, 3 * (l_tax - mt) AS pt
          FROM lineitem, m)"""


def linear_parts(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_WEIGHTS)
    return a.linear_attribution(lines, _WEIGHTS)


@query(
    "linear_attribution",
    _SQL_PHI
    + """ SELECT l_orderkey, l_linenumber, l_partkey, round(pq, 4) AS phi_l_quantity,
      round(pd, 4) AS phi_l_discount, round(pt, 4) AS phi_l_tax FROM p""",
)
def linear_attribution(spark, sf):
    parts = linear_parts(spark, sf).drop(*_WEIGHTS)
    return parts.withColumns({f"phi_{n}": rounded(f"phi_{n}") for n in _WEIGHTS})


@query(
    "mean_abs_attribution",
    _SQL_PHI
    + """ SELECT 'l_quantity' AS feature, round(avg(abs(pq)), 6) AS mean_abs FROM p
    UNION ALL SELECT 'l_discount', round(avg(abs(pd)), 6) FROM p
    UNION ALL SELECT 'l_tax', round(avg(abs(pt)), 6) FROM p""",
)
def mean_abs_attribution(spark, sf):
    found = a.mean_abs(linear_parts(spark, sf), [f"phi_{n}" for n in _WEIGHTS], "phi_")
    return found.withColumn("mean_abs", rounded("mean_abs", 6))


@query(
    "mean_abs_vector",
    """
    WITH e AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    SELECT 'emb_' || (pos - 1) AS feature, round(avg(abs(CAST(x AS DOUBLE))), 6) AS mean_abs
    FROM e GROUP BY pos""",
)
def mean_abs_vector(spark, sf):
    found = a.mean_abs_array(
        table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>")),
        "embedding",
        NAMES,
    )
    return found.withColumn("mean_abs", rounded("mean_abs", 6))


@query(
    "dependence_points",
    _SQL_PHI
    + """ SELECT 'l_discount' AS feature, l_discount AS value, round(pd, 4) AS phi FROM p
    UNION ALL SELECT 'l_quantity', l_quantity, round(pq, 4) FROM p""",
)
def dependence_points(spark, sf):
    found = a.dependence(linear_parts(spark, sf), ["l_discount", "quantity"], list(_WEIGHTS))
    return found.withColumn("phi", rounded("phi"))


@query(
    "attribution_direction",
    _SQL_PHI
    + """, u AS (SELECT 'l_quantity' AS feature, l_quantity AS v, pq AS phi FROM p
      UNION ALL SELECT 'l_discount', l_discount, pd FROM p
      UNION ALL SELECT 'l', (l_quantity + l_discount + l_tax) / 3, (pq + pd + pt) / 3 FROM p)
    SELECT feature, round(corr(v, phi), 4) AS correlation,
      CASE WHEN corr(v, phi) > 0 THEN 'increases' ELSE 'decreases' END AS direction
    FROM u GROUP BY feature""",
)
def attribution_direction(spark, sf):
    points = a.report_points(
        linear_parts(spark, sf), ["l_quantity", "l_discount", "l"], list(_WEIGHTS)
    )
    return a.direction(points).withColumn("correlation", rounded("correlation"))


def part_importances(spark, sf):
    """Feature names made of part types and names, with a summed price as importance."""
    name = F.lower(F.concat("p_type", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    return (
        table(spark, sf, "part")
        .groupBy(name.alias("feature"))
        .agg((F.sum("p_retailprice") / 1000).alias("mean_abs"))
    )


_SQL_IMPORTANCE = """
    WITH f AS (SELECT lower(p_type || '_' || replace(p_name, ' ', '_')) AS feature,
                 sum(p_retailprice) / 1000 AS mean_abs FROM part GROUP BY 1),
    t AS (SELECT *, string_split(feature, '_') AS w FROM f),
    b AS (SELECT feature, mean_abs, array_to_string(w[1:len(w) - 1], '_') AS b1,
            CASE WHEN len(w) > 2 THEN array_to_string(w[1:len(w) - 2], '_') END AS b2 FROM t),
    g AS (SELECT CASE WHEN (SELECT count(*) FROM f WHERE starts_with(f.feature, b1 || '_')) > 1 THEN b1
            WHEN (SELECT count(*) FROM f WHERE starts_with(f.feature, b2 || '_')) > 1 THEN b2
            ELSE feature END AS base, mean_abs FROM b),
    s AS (SELECT base AS feature, sum(mean_abs) AS mean_abs FROM g GROUP BY 1)"""


@query(
    "grouped_features",
    _SQL_IMPORTANCE + " SELECT feature, round(mean_abs, 4) AS mean_abs FROM s",
)
def grouped_features(spark, sf):
    found = a.group_features(part_importances(spark, sf))
    return found.withColumn("mean_abs", rounded("mean_abs"))


def _sql_top(source: str, top: int) -> str:
    return f"""
    SELECT CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank, feature,
      array_to_string(list_transform(string_split(feature, '_'),
        lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS feature_display,
      round(mean_abs, 4) AS mean_abs
    FROM {source} ORDER BY {source}.mean_abs DESC, feature LIMIT {top}"""


@query("importance_table", _SQL_IMPORTANCE + _sql_top("f", 20))
def importance_table(spark, sf):
    found = a.importance_table(part_importances(spark, sf), 20)
    return found.withColumn("mean_abs", rounded("mean_abs"))


@query("grouped_importance_table", _SQL_IMPORTANCE + _sql_top("s", 15))
def grouped_importance_table(spark, sf):
    found = a.importance_table(part_importances(spark, sf), 15, grouped=True)
    return found.withColumn("mean_abs", rounded("mean_abs"))


_AUDIT = ["Economy_Red", "ring", "has_results", "promo_small_ring_and_more"]


@query(
    "leakage_audit",
    _SQL_IMPORTANCE
    + f"""
    , q AS (SELECT unnest({_AUDIT}) AS pattern)
    SELECT pattern, count(*) FILTER (hit) AS matches, count(*) FILTER (hit) > 0 AS found
    FROM (SELECT pattern, contains(feature, lower(pattern)) OR contains(lower(pattern), feature) AS hit
          FROM f, q) GROUP BY 1""",
)
def leakage_audit(spark, sf):
    return a.leakage_audit(part_importances(spark, sf), _AUDIT)


def _tree_model(spark, sf, family):
    params = (
        {"maxIter": 5, "maxDepth": 4} if family == "boosted" else {"numTrees": 5, "maxDepth": 4}
    )
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.when(F.col("label") < 3, 1.0).otherwise(0.0).alias("target"),
    )
    return rows, tr.estimator(family, params, label="target").fit(rows)


@query("boosted_tree_attribution", "SELECT vec_id, TRUE AS additive FROM embeddings")
def boosted_tree_attribution(spark, sf):
    """Base plus contributions equals the margin of the boosted trees, for every row."""
    rows, model = _tree_model(spark, sf, "boosted")
    explained = a.tree_attribution(rows, model).select(
        "vec_id", (F.col("base") + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)).alias("sum")
    )
    margin = vector_to_array("rawPrediction")[1]
    expected = model.transform(rows).select("vec_id", margin.alias("margin"))
    close = F.abs(F.col("sum") - F.col("margin")) < 1e-6
    return explained.join(expected, "vec_id").select("vec_id", close.alias("additive"))


@query("forest_attribution", "SELECT vec_id, TRUE AS additive FROM embeddings")
def forest_attribution(spark, sf):
    """Base plus contributions equals the forest's probability of class 1, for every row."""
    rows, model = _tree_model(spark, sf, "forest")
    explained = a.tree_attribution(rows, model).select(
        "vec_id", (F.col("base") + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)).alias("sum")
    )
    probability = vector_to_array("probability")[1]
    expected = model.transform(rows).select("vec_id", probability.alias("p"))
    close = F.abs(F.col("sum") - F.col("p")) < 1e-6
    return explained.join(expected, "vec_id").select("vec_id", close.alias("additive"))


@query("audited_model")
def audited_model(spark, sf):
    """The whole audit of a boosted model: grouped importance of its features."""
    from cohortloom.plans.audit import audit_model

    rows = vector_rows(spark, sf)
    config = tr.Config("boosted", params={"maxIter": 5, "maxDepth": 3})
    model = tr.refit(rows, NAMES, config, "vec_id", "target")
    return audit_model(rows, model, NAMES, "vec_id")["raw"]


# --- noisy labels: whether a part is large, turned over for a fifth of the parts; metrics, shares and
# --- contributions follow from the table in closed form, and change with every label


PLANTED = ["noise", "large", "big_number"]
_SQL_PLANTED = """
    p AS (SELECT *, CASE WHEN (large = 1) <> (p_partkey * 31 % 10 < 2) THEN 1 ELSE 0 END AS target FROM (
      SELECT p_partkey, p_partkey * 7919 % 101 AS noise, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large,
        p_partkey * 10007 % 1000003 AS big_number FROM part))"""


def planted_parts(spark, sf):
    """Parts whose label one feature tells in four cases of five; another feature is a million times as large."""
    key = F.col("p_partkey").cast("bigint")
    large = F.col("p_size") > 25
    return table(spark, sf, "part").select(
        "p_partkey", (key * 7919 % 101).alias("noise"), large.cast("int").alias("large"),
        (key * 10007 % 1000003).alias("big_number"), (large != (key * 31 % 10 < 2)).cast("int").alias("target"),
    )


def _planted_results(spark, sf, config, cols=PLANTED, runs=1, **options):
    split = assign_split(planted_parts(spark, sf), "p_partkey", "target")
    found = tr.evaluate(split, cols, [config], "p_partkey", "target", runs=runs, **options)
    return found.select("model_name", "metric_name", rounded("mean").alias("mean"), rounded(F.coalesce("std", F.lit(0.0))).alias("std"))


def sql_planted_split():
    """Tables p (the parts) and sp (the part of the split that each belongs to)."""
    split = _sql_split("target").replace("doc_id", "p_partkey").replace("quality", "target").replace("FROM labels", "FROM p")
    return split.replace("WITH l AS", f"WITH {_SQL_PLANTED}, l AS", 1)


def _sql_told(family):
    """Metrics on the test part of a model that goes by the telling feature: its two scores have one order."""
    return f"""
    {sql_planted_split()},
    n AS (SELECT count(*) FILTER (large = 1 AND p.target = 1) AS tp, count(*) FILTER (large = 1 AND p.target = 0) AS fp,
        count(*) FILTER (large = 0 AND p.target = 1) AS fn, count(*) FILTER (large = 0 AND p.target = 0) AS tn
      FROM sp JOIN p USING (p_partkey) WHERE split = 'test')
    SELECT '{family}' AS model_name, m AS metric_name, 0.0 AS std, round(CASE m
        WHEN 'accuracy' THEN (tp + tn) / (tp + tn + fp + fn) WHEN 'precision' THEN tp / (tp + fp) WHEN 'recall' THEN tp / (tp + fn)
        WHEN 'f1' THEN 2 * tp / (2 * tp + fp + fn) ELSE (1 + tp / (tp + fn) - fp / (fp + tn)) / 2 END, 4) AS mean
    FROM n, (SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) AS m)"""


@query("planted_network_results", _sql_told("network"))
def planted_network_results(spark, sf):
    """The decision threshold comes from the validation part."""
    params = {"hidden": [4], "maxIter": 60}
    return _planted_results(spark, sf, tr.Config("network", strategy="oversample_1.0", params=params), ["large"])


@query("planted_forest_results", _sql_told("forest"))
def planted_forest_results(spark, sf):
    """The grid's depth is searched over folds; both trees cut at the telling feature alone. Two runs agree."""
    params = {"numTrees": 1, "featureSubsetStrategy": "all", "bootstrap": False, "minInfoGain": 0.05}
    grid = {"forest": {"maxDepth": [1, 2]}}
    return _planted_results(spark, sf, tr.Config("forest", params=params), runs=2, grids=grid, folds=3)


@query("planted_boosted_results", _sql_told("boosted"))
def planted_boosted_results(spark, sf):
    config = tr.Config("boosted", strategy="downsample_balanced", params={"maxIter": 1, "maxDepth": 1})
    return _planted_results(spark, sf, config)


@query("planted_svm_results", _sql_told("svm"))
def planted_svm_results(spark, sf):
    return _planted_results(spark, sf, tr.Config("svm", params={"maxIter": 50}), ["large"])


@query("planted_importances")
def planted_importances(spark, sf):
    """A smoke test; ``gain_importances`` has numbers to compare."""
    params = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.1}
    rows = planted_parts(spark, sf)
    _, importances = tr.select_features(rows, PLANTED, "target", min_keep=1, params=params)
    return importances.select("feature", rounded("importance").alias("importance"), "kept")


def _stump(spark, sf):
    """One tree with one split; no rows are drawn, so its shares are those of the table."""
    params = {"numTrees": 1, "maxDepth": 1, "featureSubsetStrategy": "all", "bootstrap": False}
    rows = planted_parts(spark, sf)
    config = tr.Config("forest", params=params, weighted=False)
    return rows, tr.refit(rows, PLANTED, config, "p_partkey", "target")


@query(
    "saved_stump_scores",
    f"WITH {_SQL_PLANTED} SELECT p_partkey, round(avg(target) OVER (PARTITION BY large), 4) AS p_completion FROM p",
)
def saved_stump_scores(spark, sf):
    """Saved, loaded and scored: the leaf shares of the single split."""
    rows, model = _stump(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(model, {"model_name": "forest", "feature_names": PLANTED, "random_state": 42}, path)
    loaded, metadata = load_model(spark, path)
    scored = score(rows.select("p_partkey", *metadata["feature_names"]), loaded)
    return scored.select("p_partkey", rounded("p_completion").alias("p_completion"))


@query(
    "stump_attribution",
    f"""
    WITH {_SQL_PLANTED}
    SELECT p_partkey, 0.0 AS phi_noise, round(avg(target) OVER (PARTITION BY large) - avg(target) OVER (), 6) + 0.0 AS phi_large,
      0.0 AS phi_big_number FROM p""",
)
def stump_attribution(spark, sf):
    """With one split, the Shapley value is the leaf's share minus the table's."""
    from cohortloom.plans.audit import explained

    rows, model = _stump(spark, sf)
    found = explained(rows.drop("target"), model, PLANTED, "p_partkey")
    return found.select("p_partkey", *[rounded(f"phi_{n}", 6).alias(f"phi_{n}") for n in PLANTED])


@query(
    "kernel_attribution",
    f"""
    WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey * 7919 % 101 AS DOUBLE) AS b, p_retailprice AS c FROM part),
    g AS (SELECT avg(a) AS ea, avg(b) AS eb, avg(c) AS ec, avg(a * b) AS eab FROM (SELECT * FROM v
      ORDER BY CAST('0x' || left(md5(CAST(p_partkey AS VARCHAR) || ':42'), 13) AS BIGINT), p_partkey LIMIT 100))
    SELECT p_partkey, round((a * eb - eab + a * b - ea * b) / 2, 4) + 0.0 AS phi_a,
      round((b * ea - eab + a * b - eb * a) / 2, 4) + 0.0 AS phi_b, round(10 * (c - ec), 4) + 0.0 AS phi_c FROM v, g""",
)
def kernel_attribution_of_a_product(spark, sf):
    """Exact Shapley values of a * b + 10 * c over a background of 100 rows."""
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("a"),
        (F.col("p_partkey").cast("bigint") * 7919 % 101).cast("double").alias("b"), F.col("p_retailprice").cast("double").alias("c"),
    )
    found = kernel_attribution(
        rows, lambda df: df.withColumn("score", F.col("a") * F.col("b") + 10 * F.col("c")), ["a", "b", "c"], "p_partkey"
    )
    return found.select("p_partkey", *[rounded(f"phi_{n}").alias(f"phi_{n}") for n in "abc"])


@query(
    "svm_audit_adds_up",
    f"""
    WITH {_SQL_PLANTED}
    SELECT p_partkey, round(large - avg(large) OVER (), 6) + 0.0 AS share_of_step, 0.0 AS gap FROM p""",
)
def svm_audit_adds_up(spark, sf):
    """Contributions in units of the model's step from 0 to 1, and what they miss of margin minus mean."""
    from cohortloom.plans.audit import explained

    rows = planted_parts(spark, sf)
    model = tr.refit(rows, ["large"], tr.Config("svm", params={"maxIter": 10}, weighted=False), "p_partkey", "target")
    margin = vector_to_array("_margin_raw")[1]
    scored = model.transform(rows).select("p_partkey", margin.alias("margin"))
    mean = scored.agg(F.avg("margin").alias("mean")).scalar()
    found = explained(rows.drop("target"), model, ["large"], "p_partkey").select("p_partkey", F.col("phi_large").alias("phi"))
    step = found.agg((F.max("phi") - F.min("phi")).alias("step")).scalar()
    return scored.join(found, "p_partkey").select(
        "p_partkey", rounded(F.col("phi") / step, 6).alias("share_of_step"), rounded(F.col("margin") - mean - F.col("phi"), 6).alias("gap")
    )
