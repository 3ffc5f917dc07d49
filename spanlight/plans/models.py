"""Queries over models and what surrounds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import metrics as M
from spanlight.operators import models as L
from spanlight.operators import windows as W
from spanlight.plans import views as V
from spanlight.plans.graph import _GRAPH, _SC, entities
from spanlight.plans.registry import query
from spanlight.plans.windows import _shares


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window features with their truth and a fold from the day."""
    flow = V.flow(spark, sf_dir)
    w = W.window_profile(flow, V.WINDOW, ["size"], ["flag"], _shares())
    truth = flow.groupBy(W.bucket(F.col("ts_s"), V.WINDOW).alias("window_start")).agg(F.max("label").alias("y"))
    return w.join(truth, "window_start").withColumn("fold", (F.floor(F.col("window_start") / 86400) % 3 + 1).cast("int"))


@query("m01_window_detectors")
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.balanced_weights(window_rows(spark, sf_dir), "y")
    features = [c for c in rows.columns if c.endswith(("_mean", "_std", "_max", "_share", "_sum", "row_count"))]
    out = L.out_of_fold(rows, features, "y", "fold", ("logistic", "trees", "mlp"))
    return out.select("window_start", "fold", "model", F.col("y").alias("truth"), F.round(F.element_at("probabilities", 2), 6).alias("score"))


@query("m02_balanced_weights", "SELECT y, count(*) AS n, round(sum(w), 6) AS weight FROM (SELECT y, (SELECT count(*) FROM scored) / (2 * count(*) OVER (PARTITION BY y)) AS w FROM scored) GROUP BY 1")
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.balanced_weights(V.scored(spark, sf_dir).select("case_id", "y"), "y").groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    "m02_oversampling",
    """, p AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS place FROM scored WHERE y = 1), c AS (SELECT count(*) FILTER (WHERE y = 1) AS n, count(*) FILTER (WHERE y = 0) - count(*) FILTER (WHERE y = 1) AS extra FROM scored),
d AS (SELECT i, floor(('0x' || substr(md5('over|' || i), 1, 8))::BIGINT / 4294967296.0 * n)::BIGINT AS place FROM c, (SELECT unnest(range(1, (SELECT extra FROM c) + 1)) AS i))
SELECT case_id, count(*) AS copies FROM d JOIN p USING (place) GROUP BY 1""",
)
def m02b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.oversample(V.scored(spark, sf_dir).select("case_id", "y"), "y", "case_id", "over").where("copy > 0").groupBy("case_id").agg(F.count("*").alias("copies"))


@query(
    "m03_case_weights",
    "SELECT h, y, count(*) AS n, round(sum(CASE WHEN y = 1 THEN 0.5 / p ELSE 0.5 / q END), 9) AS weight FROM (SELECT h, y, sum(y) OVER (PARTITION BY h) AS p, sum(1 - y) OVER (PARTITION BY h) AS q FROM scored) WHERE p > 0 AND q > 0 GROUP BY 1, 2",
)
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.case_weights(V.scored(spark, sf_dir).select("h", "y"), "h", "y").groupBy("h", "y").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("weight"))


@query("m04_process_ranker")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where("kind = 'process'").withColumn("fold", (F.xxhash64("case_id") % 3 + 3) % 3)
    rows = L.case_weights(e, "case_id", "label").withColumnRenamed("label", "truth")
    out = L.out_of_fold(rows, ["in_degree", "out_degree", "closest", "proximity", "degree_score", "recency_degree"], "truth", "fold", ("logistic", "trees"))
    return out.select("case_id", "id", "model", "truth", F.round(F.element_at("probabilities", 2), 6).alias("score"))


@query("m05_class_posteriors")
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.select("vec_id", "label", *(F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(64))).withColumn("fold", (F.col("vec_id") % 3).cast("int")).withColumn("weight", F.lit(1.0)).withColumnRenamed("label", "class")
    out = L.out_of_fold(rows, [f"e{i}" for i in range(64)], "class", "fold")
    p = F.col("probabilities")
    return out.select("vec_id", "fold", F.col("predicted").cast("int").alias("predicted"), F.round(L.entropy(p), 6).alias("entropy"), F.round(L.margin(p), 6).alias("margin"))


_TFIDF = r""", ws AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}') AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), vb AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 500), v AS (SELECT doc_id, tf.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM ws)) / (1 + df)) + 1) AS value FROM tf JOIN vb USING (term))
SELECT doc_id, term, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 9) AS value FROM v"""


@query("m06_tfidf", _TFIDF)
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tfidf(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumn("value", F.round("value", 9))


def _posterior(shift: int) -> str:
    weights = [f"(1 + (k * {i + 1} + {shift}) % 7)::DOUBLE" for i in range(4)]
    return f"list_transform([{', '.join(weights)}], lambda x: x / ({' + '.join(weights)}))"


def _posterior_col(shift: int):
    weights = [(1 + (F.col("k") * (i + 1) + shift) % 7).cast("double") for i in range(4)]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    return F.array(*(w / total for w in weights))


_PQ = f"pq AS (SELECT k, {_posterior(0)} AS p, {_posterior(3)} AS q FROM (SELECT DISTINCT k FROM base))"


@query(
    "m07_m08_pair_features",
    f""", {_PQ}, z AS (SELECT k, p, q, list_transform(list_zip(p, q), lambda x: x[1] * ln(2 * x[1] / (x[1] + x[2]))) AS a, list_transform(list_zip(p, q), lambda x: x[2] * ln(2 * x[2] / (x[1] + x[2]))) AS b FROM pq)
SELECT k, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) AS entropy_a, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 9) AS margin_a, round(0.5 * list_sum(a) + 0.5 * list_sum(b), 9) AS js, round(list_sum(list_transform(list_zip(p, q), lambda x: sqrt(x[1] * x[2]))), 9) AS affinity,
  round(list_sum(list_transform(list_zip(p, q), lambda x: abs(x[1] - x[2]))), 9) AS l1, round(p[2] * q[3], 9) AS x_1_2 FROM z""",
)
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.base(spark, sf_dir).select("k").distinct().select("k", _posterior_col(0).alias("p"), _posterior_col(3).alias("q"))
    f = L.pair_features(F.col("p"), F.col("q"), 4)
    return rows.select("k", *(F.round(f[c], 9).alias(c) for c in ("entropy_a", "margin_a", "js", "affinity", "l1", "x_1_2")))


_TOP = "rows9 AS (SELECT case_id, id, r AS rank, score, in_degree AS sockets, proximity AS delta FROM rk WHERE r <= 10)"


@query(
    "m09_corruptions",
    f""", {_GRAPH}, {_SC}, {_TOP}, f AS (SELECT *, ('0x' || substr(sha256(case_id || '|' || id), 16, 1))::INT % 2 = 0 AS even FROM rows9, (SELECT unnest(['delete_process', 'delete_socket', 'shift_time', 'half_delete']) AS family)),
s AS (SELECT *, bool_or(even) OVER (PARTITION BY case_id, family) AS has_even FROM f), n9 AS (SELECT a.case_id, a.tactic, (SELECT count(*) FROM anchored b WHERE b.tactic <> a.tactic) AS n FROM anchored a),
o9 AS (SELECT k.tactic, e.case_id AS donor_id, row_number() OVER (PARTITION BY k.tactic ORDER BY e.tactic, e.case_id) - 1 AS place FROM (SELECT DISTINCT tactic FROM anchored) k JOIN anchored e ON e.tactic <> k.tactic),
d9 AS (SELECT n9.case_id, donor_id FROM n9 JOIN o9 ON o9.tactic = n9.tactic AND o9.place = ('0x' || substr(sha256('context|' || n9.case_id), 1, 15))::BIGINT % n9.n)
SELECT case_id, id, family, CASE family WHEN 'delete_socket' THEN 0 WHEN 'half_delete' THEN round_even(sockets / 2, 0)::BIGINT ELSE sockets END AS sockets, round(CASE family WHEN 'shift_time' THEN delta + 600 ELSE delta END, 6) AS delta FROM s WHERE family <> 'delete_process' AND (family <> 'half_delete' OR even OR (NOT has_even AND rank = 1))
UNION ALL SELECT d9.case_id, id, 'replace_context', sockets, round(delta, 6) FROM d9 JOIN rows9 ON rows9.case_id = d9.donor_id""",
)
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlight.operators.joins import hashed_donor, top_k
    from spanlight.plans.windows import cases

    e = entities(spark, sf_dir).where("kind = 'process'").select("case_id", "id", F.round("recency_degree", 6).alias("score"), F.col("in_degree").alias("sockets"), F.col("proximity").alias("delta"))
    rows = top_k(e, ["case_id"], [F.desc("score"), F.asc("id")], 10)
    donors = hashed_donor(cases(spark, sf_dir).select("case_id", "tactic").withColumn("block", F.lit(0)), "block", "case_id", "tactic", "context")
    return L.corrupt(rows, ["delete_process", "delete_socket", "shift_time", "half_delete", "replace_context"], donors).select("case_id", "id", "family", "sockets", F.round("delta", 6).alias("delta"))


@query("m11_binding_model")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlight.operators.joins import nearest_donors

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    donors = nearest_donors(v.withColumn("block", F.lit(0)), "block", "vec_id", "embedding", "label").where("not same")
    a = v.select("vec_id", "label", F.col("embedding").alias("x"))
    other = v.select(F.col("vec_id").alias("donor_id"), F.col("embedding").alias("z"))
    true = a.select("vec_id", "label", "x", F.col("x").alias("z"), F.lit(1).alias("bound"))
    false = a.join(donors.select("vec_id", "donor_id"), "vec_id").join(other, "donor_id").select("vec_id", "label", "x", "z", F.lit(0).alias("bound"))
    half = lambda c, lo: F.slice(c, lo, 32)
    pairs = true.unionByName(false).withColumns(
        {f"d{i}": F.element_at(half("x", 1), i + 1).cast("double") * F.element_at(half("z", 33), i + 1).cast("double") for i in range(32)} | {"l1": L.l1_distance(half("x", 1), half("z", 1)).cast("double")}
    )
    rows = L.balanced_weights(pairs.withColumn("fold", (F.col("vec_id") % 3).cast("int")).drop("x", "z"), "bound")
    out = L.out_of_fold(rows, [*(f"d{i}" for i in range(32)), "l1"], "bound", "fold")
    return out.select("vec_id", "bound", F.round(F.element_at("probabilities", 2), 6).alias("score"))


@query(
    "m13_majority_baseline",
    "SELECT s.fold, b.tactic AS predicted, count(*) AS n, round(avg((s.tactic = b.tactic)::INT), 9) AS accuracy FROM scored s JOIN (SELECT fold, arg_max(tactic, (n, -tactic)) AS tactic FROM (SELECT f.fold, s.tactic, count(*) AS n FROM (SELECT DISTINCT fold FROM scored) f JOIN scored s ON s.fold <> f.fold GROUP BY 1, 2) GROUP BY 1) b USING (fold) GROUP BY 1, 2",
)
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.majority_baseline(V.scored(spark, sf_dir), "fold", "tactic").withColumn("accuracy", F.round("accuracy", 9))


@query(
    "j15_case_accounting",
    """, pr AS (SELECT case_id, max((score >= 0.3)::INT) AS alerted, max(y) AS present, max(accepted) AS accepted, max(accepted * correct) AS right_n FROM decision WHERE condition = 'clean' GROUP BY 1)
SELECT alerted, present, count(*) AS n, sum(accepted)::BIGINT AS accepted_n, sum(right_n)::BIGINT AS correct_n FROM pr GROUP BY 1, 2""",
)
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.decision(spark, sf_dir).where("condition = 'clean'")
    alerts = V.scored(spark, sf_dir).select("case_id", (F.col("score") >= 0.3).cast("int").alias("alerted"), F.col("y").alias("present"))
    j = alerts.join(d.select("case_id", "accepted", (F.col("accepted") * F.col("correct")).alias("right_n")), "case_id")
    return j.groupBy("alerted", "present").agg(F.count("*").alias("n"), F.sum("accepted").alias("accepted_n"), F.sum("right_n").alias("correct_n"))
