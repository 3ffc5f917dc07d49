"""Queries over scored cases: ranking, detection and accept-or-abstain metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.functions import scalars as S
from spanlight.operators import metrics as M
from spanlight.plans import views as V
from spanlight.plans.registry import query

# Cases of the ranking queries are hours; their candidates are the events of the hour.
_RK = "rs AS (SELECT h AS \"case\", case_id AS id, fold, tactic, score, y FROM scored)"


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scored(spark, sf_dir).select(F.col("h").alias("case"), F.col("case_id").alias("id"), "fold", "tactic", "score", "y")


def _round(df: DataFrame, *columns: str, to: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


_R1 = """r1 AS (SELECT "case", count(*) AS candidates, min(r) FILTER (WHERE y = 1) AS best_rank, max(id) FILTER (WHERE r = 1) AS top_id FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, id) AS r FROM rs) GROUP BY 1)"""


@query(
    "r01_best_ranks",
    f', {_RK}, {_R1} SELECT "case", candidates, best_rank, top_id, round(coalesce(1 / best_rank, 0), 9) AS reciprocal, round(best_rank / candidates, 9) AS normalised, coalesce((best_rank <= 1)::INT, 0) AS hit_1, coalesce((best_rank <= 5)::INT, 0) AS hit_5, coalesce((best_rank <= 10)::INT, 0) AS hit_10 FROM r1',
)
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.best_ranks(ranking(spark, sf_dir)), "reciprocal", "normalised")


_R2 = """r2 AS (SELECT "case", count(*) FILTER (WHERE score > t) AS better, count(*) FILTER (WHERE score = t) AS tied, count(*) FILTER (WHERE score = t AND y = 1) AS tied_true FROM (SELECT *, max(score) FILTER (WHERE y = 1) OVER (PARTITION BY "case") AS t FROM rs) WHERE t IS NOT NULL GROUP BY 1)"""


@query("r02_tie_bounds", f', {_RK}, {_R2} SELECT "case", better + 1 AS optimistic, better + tied - tied_true + 1 AS pessimistic, better + (tied + 1) / 2 AS mid_rank, tied, tied_true FROM r2')
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tie_bounds(ranking(spark, sf_dir))


_SIZES = 'sz AS (SELECT "case", count(*) AS n, sum(y)::BIGINT AS t FROM rs GROUP BY 1)'


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking(spark, sf_dir).groupBy("case").agg(F.count("*").alias("n"), F.sum("y").alias("t"))


@query(
    "r03_hit_probability",
    f""", {_RK}, {_SIZES} SELECT "case", n, t, round(CASE WHEN t = 0 THEN 0 ELSE 1 - list_product(list_transform(range(0, least(5, n)), lambda i: greatest(0, (n - t - i) / greatest(n - i, 1)))) END, 9) AS hit_5 FROM sz""",
)
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("case", "n", "t", F.round(M.hit_probability(F.col("n"), F.col("t"), F.lit(5).cast("bigint")), 9).alias("hit_5"))


_FIRST = "SELECT {k}, sum(hit / (before + i + 1)) AS e FROM (SELECT {k}, before, i, t / (n - i) * coalesce(exp(sum(ln(greatest(1e-300, 1 - t / (n - i)))) OVER (PARTITION BY {k} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS hit FROM (SELECT {k}, n, t, before, unnest(range(0, n - t + 1)) AS i FROM {src} WHERE t > 0)) GROUP BY ALL"


@query(
    "r04_random_baseline",
    f""", {_RK}, {_SIZES}, src AS (SELECT "case", n, t, 0 AS before FROM sz), e AS ({_FIRST.format(k='"case"', src='src')}) SELECT sz."case", round(coalesce(e.e, 0), 9) AS expected_reciprocal, round(CASE WHEN t > 0 THEN (n + 1) / (t + 1) END, 9) AS expected_rank FROM sz LEFT JOIN e USING ("case")""",
)
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("n"), F.col("t")
    out = sizes(spark, sf_dir).select("case", M.expected_reciprocal(n, t, F.lit(0)).alias("expected_reciprocal"), F.when(t > 0, (n + 1) / (t + 1)).alias("expected_rank"))
    return _round(out, "expected_reciprocal", "expected_rank")


@query(
    "r05_tied_reciprocal",
    f""", {_RK}, {_R2}, src AS (SELECT "case", tied AS n, tied_true AS t, better AS before FROM r2), e AS ({_FIRST.format(k='"case"', src='src')}) SELECT "case", round(e, 9) AS expected_reciprocal FROM e""",
)
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.tie_bounds(ranking(spark, sf_dir))
    return b.select("case", F.round(M.expected_reciprocal(F.col("tied"), F.col("tied_true"), F.col("optimistic") - 1), 9).alias("expected_reciprocal"))


@query(
    "r06_grouped_summary",
    f""", {_RK}, {_R1}, c AS (SELECT r1.*, d.fold, d.tactic FROM r1 JOIN (SELECT h, min(fold) AS fold, max(tactic) AS tactic FROM scored GROUP BY 1) d ON d.h = r1."case")
SELECT coalesce(fold::VARCHAR, 'all') AS fold, coalesce(tactic::VARCHAR, 'all') AS tactic, count(*) AS cases_n, round(avg((best_rank IS NOT NULL)::INT), 9) AS ceiling, round(avg(candidates), 9) AS mean_candidates, quantile_cont(candidates, 0.5) AS median_candidates, max(candidates) AS max_candidates,
  round(avg(coalesce(1 / best_rank, 0)), 9) AS mrr, round(avg(1 / best_rank), 9) AS mrr_present, round(avg(coalesce((best_rank <= 5)::INT, 0)), 9) AS recall_5 FROM c GROUP BY GROUPING SETS ((fold), (tactic), ())""",
)
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = V.scored(spark, sf_dir).groupBy(F.col("h").alias("case")).agg(F.min("fold").alias("fold"), F.max("tactic").alias("tactic"))
    c = M.best_ranks(ranking(spark, sf_dir)).join(about, "case")
    out = c.groupingSets([["fold"], ["tactic"], []], "fold", "tactic").agg(
        F.count("*").alias("cases_n"), F.avg(F.col("best_rank").isNotNull().cast("int")).alias("ceiling"), F.avg("candidates").alias("mean_candidates"), F.percentile("candidates", F.lit(0.5)).alias("median_candidates"), F.max("candidates").alias("max_candidates"),
        F.avg("reciprocal").alias("mrr"), F.avg(1 / F.col("best_rank")).alias("mrr_present"), F.avg("hit_5").alias("recall_5"),
    )
    named = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("fold", "tactic")})
    return _round(named, "ceiling", "mean_candidates", "mrr", "mrr_present", "recall_5")


@query("r07_tie_summary", f", {_RK}, {_R2} SELECT round(avg(tied), 9) AS mean_tied, quantile_cont(tied, 0.5) AS median_tied, round(quantile_cont(tied, 0.95), 9) AS p95_tied, round(avg((tied > 1)::INT), 9) AS share_tied FROM r2")
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tied")
    return M.tie_bounds(ranking(spark, sf_dir)).agg(F.round(F.avg(t), 9).alias("mean_tied"), F.percentile(t, F.lit(0.5)).alias("median_tied"), F.round(F.percentile(t, F.lit(0.95)), 9).alias("p95_tied"), F.round(F.avg((t > 1).cast("int")), 9).alias("share_tied"))


@query(
    "r08_size_bins",
    f""", {_RK}, {_R1} SELECT CASE WHEN candidates <= 20 THEN '<=20' WHEN candidates <= 100 THEN '21-100' ELSE '>100' END AS bin, count(*) AS cases_n, round(avg(coalesce(1 / best_rank, 0)), 9) AS mrr, round(avg(coalesce((best_rank <= 5)::INT, 0)), 9) AS recall_5 FROM r1 GROUP BY 1""",
)
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.best_ranks(ranking(spark, sf_dir))
    return _round(r.groupBy(S.size_bin(F.col("candidates")).alias("bin")).agg(F.count("*").alias("cases_n"), F.avg("reciprocal").alias("mrr"), F.avg("hit_5").alias("recall_5")), "mrr", "recall_5")


@query(
    "r09_seed_fold_aggregation",
    "SELECT model, round(avg(m), 9) AS mean_of_folds, round(stddev_samp(m), 9) AS std_of_folds, sum(n)::BIGINT AS n FROM (SELECT model, fold, avg(m) AS m, sum(n) AS n FROM (SELECT model, fold, seed, avg(score) AS m, count(*) AS n FROM scored GROUP BY ALL) GROUP BY ALL) GROUP BY 1",
)
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = V.scored(spark, sf_dir).where(~F.isnan("score")).groupBy("model", "fold", "seed").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    folds = seeds.groupBy("model", "fold").agg(F.avg("m").alias("m"), F.sum("n").alias("n"))
    return folds.groupBy("model").agg(F.round(F.avg("m"), 9).alias("mean_of_folds"), F.round(F.stddev_samp("m"), 9).alias("std_of_folds"), F.sum("n").alias("n"))


@query(
    "r10_ndcg",
    f""", {_RK}, k AS (SELECT "case", y, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, id) AS r FROM rs), a AS (SELECT "case", sum(CASE WHEN r <= 10 AND y = 1 THEN 1 / log2(r + 1) ELSE 0 END) AS dcg, sum(y)::BIGINT AS t, min(r) FILTER (WHERE y = 1) AS best FROM k GROUP BY 1)
SELECT "case", round(CASE WHEN t > 0 THEN dcg / list_sum(list_transform(range(1, least(t, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 9) AS ndcg, coalesce((best <= 10)::INT, 0) AS hit, round(coalesce(1 / best, 0), 9) AS reciprocal FROM a""",
)
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.ndcg(ranking(spark, sf_dir), 10), "ndcg", "reciprocal")


_KEYS = ["fold", "seed", "model"]
_STEPS = "st AS (SELECT fold, seed, model, score, sum(y)::BIGINT AS tp, sum(1 - y)::BIGINT AS fp FROM scored GROUP BY ALL), cu AS (SELECT *, sum(tp) OVER w AS tpc, sum(fp) OVER w AS fpc FROM st WINDOW w AS (PARTITION BY fold, seed, model ORDER BY score DESC))"
_HOURS = 720
_THR = """th AS (SELECT k.fold, k.seed, k.model, coalesce(b.score, 'inf'::DOUBLE) AS threshold, coalesce(b.tpc, 0)::BIGINT AS true_alerts, coalesce(b.fpc, 0)::BIGINT AS false_alerts FROM (SELECT DISTINCT fold, seed, model FROM scored) k LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, seed, model ORDER BY tpc DESC, fpc, score DESC) AS place FROM cu WHERE fpc <= 72) WHERE place = 1) b USING (fold, seed, model))"""


@query("d01_thresholds", f", {_STEPS}, {_THR} SELECT * FROM th")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_threshold(V.scored(spark, sf_dir), _KEYS, 0.1, _HOURS)


@query(
    "d02_curve_areas",
    f", {_STEPS} SELECT fold, seed, model, round(sum(tp * tpc / (tpc + fpc)) / sum(tp), 9) AS ap, round(sum(fp * (tpc - tp / 2)) / sum(tp) / sum(fp), 9) AS auc FROM cu GROUP BY ALL",
)
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.curve_areas(V.scored(spark, sf_dir), _KEYS), "ap", "auc")


_METRICS = "count(*) FILTER (WHERE score >= threshold) AS alerts, round(count(*) FILTER (WHERE score >= threshold AND y = 1) / nullif(count(*) FILTER (WHERE score >= threshold), 0), 9) AS precision, round(count(*) FILTER (WHERE score >= threshold AND y = 1) / nullif(sum(y), 0), 9) AS recall, round(count(*) FILTER (WHERE score >= threshold AND y = 0) / 720, 9) AS false_per_hour"


@query("d03_window_metrics", f", {_STEPS}, {_THR} SELECT s.fold, s.seed, s.model, {_METRICS} FROM scored s JOIN th USING (fold, seed, model) GROUP BY ALL")
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir)
    t = M.select_threshold(s, _KEYS, 0.1, _HOURS)
    return _round(M.window_metrics(s.join(F.broadcast(t), _KEYS), _KEYS, F.col("threshold"), _HOURS), "precision", "recall", "false_per_hour")


@query(
    "d04_event_coverage",
    f""", {_STEPS}, {_THR}, w AS (SELECT h, max(score) AS best, max((score >= threshold)::INT) AS covered FROM scored JOIN th USING (fold, seed, model) GROUP BY 1),
cw AS (SELECT case_id, tactic, unnest(generate_series((floor(start_s / 3600))::BIGINT, (floor(end_s / 3600))::BIGINT)) AS h FROM cases), p AS (SELECT case_id, any_value(tactic) AS tactic, max(covered) AS covered, max(best) AS best, count(best) AS visible FROM cw LEFT JOIN w USING (h) GROUP BY 1)
SELECT tactic, count(*) AS cases_n, sum(coalesce(covered, 0))::BIGINT AS covered_n, round(avg(coalesce(covered, 0)), 9) AS coverage, round(avg(coalesce(covered, 0)) FILTER (WHERE visible > 0), 9) AS coverage_visible, max(best) AS best FROM p GROUP BY 1""",
)
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlight.plans.windows import case_windows

    s = V.scored(spark, sf_dir)
    t = M.select_threshold(s, _KEYS, 0.1, _HOURS)
    w = s.join(F.broadcast(t), _KEYS).groupBy((F.col("h") * 3600).alias("window_start")).agg(F.max("score").alias("best"), F.max((F.col("score") >= F.col("threshold")).cast("int")).alias("covered"))
    per = case_windows(spark, sf_dir).join(w, "window_start", "left").groupBy("case_id", "tactic").agg(F.coalesce(F.max("covered"), F.lit(0)).alias("covered"), F.max("best").alias("best"), F.count("best").alias("visible"))
    out = per.groupBy("tactic").agg(F.count("*").alias("cases_n"), F.sum("covered").alias("covered_n"), F.avg("covered").alias("coverage"), F.avg(F.when(F.col("visible") > 0, F.col("covered"))).alias("coverage_visible"), F.max("best").alias("best"))
    return _round(out, "coverage", "coverage_visible")


@query(
    "d05_budget_frontier",
    f""", {_STEPS}, b AS (SELECT unnest([0.05, 0.1, 0.2, 0.5]::DOUBLE[]) AS budget), f AS (SELECT budget, cu.*, row_number() OVER (PARTITION BY budget, fold, seed, model ORDER BY tpc DESC, fpc, score DESC) AS place FROM cu, b WHERE fpc <= floor(budget * 720 + 1e-9))
SELECT budget, sum(tpc)::BIGINT AS true_alerts, sum(fpc)::BIGINT AS false_alerts, round(sum(tpc) / (SELECT sum(y) FROM scored), 9) AS recall FROM f WHERE place = 1 GROUP BY 1""",
)
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir)
    per = M.expand(M.score_steps(s, _KEYS), "budget", [0.05, 0.1, 0.2, 0.5]).where(F.col("fp_cum") <= F.floor(F.col("budget") * _HOURS + 1e-9))
    best = per.groupBy("budget", *_KEYS).agg(F.max(F.struct("tp_cum", (-F.col("fp_cum")).alias("less"), "score")).alias("m"))
    total = F.broadcast(s.agg(F.sum("y").alias("all_y")))
    out = best.groupBy("budget").agg(F.sum("m.tp_cum").alias("true_alerts"), F.sum(-F.col("m.less")).alias("false_alerts")).crossJoin(total)
    return out.select("budget", "true_alerts", "false_alerts", F.round(F.col("true_alerts") / F.col("all_y"), 9).alias("recall"))


@query(
    "a01_fixed_coverage",
    "SELECT fold, count(*) AS n, round(avg((tactic <> prediction)::INT), 9) AS risk, min(score) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, case_id) AS r, count(*) OVER (PARTITION BY fold) AS n FROM scored) WHERE r <= greatest(1, round_even(n * 0.8::DOUBLE, 0)) GROUP BY 1",
)
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = M.fixed_coverage(V.scored(spark, sf_dir), ["fold"], 0.8)
    return chosen.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("tactic") != F.col("prediction")).cast("int")), 9).alias("risk"), F.min("score").alias("lowest"))


_KTH = """kt AS (SELECT fold, max(score) FILTER (WHERE r = greatest(1, k)) AS rounded, max(score) FILTER (WHERE r = greatest(1, u)) AS retained, max(score) FILTER (WHERE r = k + 1) AS nxt, max(k) AS k FROM (SELECT *, round_even(n * 0.7::DOUBLE, 0) AS k, ceil(n * 0.7::DOUBLE) AS u FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, case_id) AS r, count(*) OVER (PARTITION BY fold) AS n FROM scored)) GROUP BY 1)"""


@query("a02_kth_thresholds", f", {_KTH} SELECT fold, rounded, retained, CASE WHEN k = 0 THEN 'inf'::DOUBLE WHEN nxt IS NULL OR nxt < rounded THEN rounded END AS exact FROM kt")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kth_thresholds(V.scored(spark, sf_dir), ["fold"], 0.7)


@query(
    "a03_eligible_thresholds",
    "SELECT fold, max(score) FILTER (WHERE r = 400) AS threshold, count(*) AS eligible FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, case_id) AS r FROM scored WHERE tactic = prediction) GROUP BY 1",
)
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = V.scored(spark, sf_dir).where("tactic = prediction")
    return M.kth_score(eligible, ["fold"], 400).select("fold", "threshold", F.col("rows_n").alias("eligible"))


_OUT = "count(*) AS events_n, count(*) FILTER (WHERE accepted = 1) AS accepted_n, count(*) FILTER (WHERE accepted = 1 AND correct = 1) AS correct_n"
_OUTC = "oc AS (SELECT model, condition, {o} FROM decision GROUP BY ALL), om AS (SELECT *, accepted_n - correct_n AS wrong_n, round(accepted_n / events_n, 9) AS coverage, round((accepted_n - correct_n) / events_n, 9) AS wrong_rate, round((accepted_n - correct_n) / nullif(accepted_n, 0), 9) AS risk, round((events_n - accepted_n) / events_n, 9) AS rejection FROM oc)".format(o=_OUT)


def family_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.outcomes(V.decision(spark, sf_dir), ["model", "condition"]), "coverage", "wrong_rate", "risk", "rejection")


@query("a04_outcomes", f", {_OUTC} SELECT * FROM om")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_outcomes(spark, sf_dir)


@query("a05_macro_wrong", f", {_OUTC} SELECT model, round(avg(wrong_rate), 9) AS macro_wrong, round(avg(wrong_rate) FILTER (WHERE condition <> 'shift_time'), 9) AS macro_wrong_without_shift FROM om WHERE condition <> 'clean' GROUP BY 1")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = family_outcomes(spark, sf_dir).where("condition <> 'clean'")
    return o.groupBy("model").agg(F.round(F.avg("wrong_rate"), 9).alias("macro_wrong"), F.round(F.avg(F.when(F.col("condition") != "shift_time", F.col("wrong_rate"))), 9).alias("macro_wrong_without_shift"))


_CURVE = "cv AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY score DESC, case_id) AS rank, sum(1 - correct) OVER (PARTITION BY model ORDER BY score DESC, case_id ROWS UNBOUNDED PRECEDING) AS errors, count(*) OVER (PARTITION BY model) AS n FROM decision WHERE condition = 'clean')"


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = V.decision(spark, sf_dir).where("condition = 'clean'")
    sizes = clean.groupBy("model").agg(F.count("*").alias("n"))
    return M.risk_curve(clean, ["model"]).join(F.broadcast(sizes), "model")  # one row a model


@query("a06_risk_coverage", f", {_CURVE} SELECT model, c AS tenths, rank AS accepted_n, round(errors / rank, 9) AS risk FROM cv, (SELECT unnest(range(1, 11)) AS c) WHERE rank = greatest(1, round_even(n * c / 10::DOUBLE, 0))")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.expand(curve(spark, sf_dir), "tenths", range(1, 11)).where(F.col("rank") == F.greatest(F.lit(1), F.bround(F.col("n") * F.col("tenths") / 10.0, 0)))
    return c.select("model", "tenths", F.col("rank").alias("accepted_n"), F.round(F.col("errors") / F.col("rank"), 9).alias("risk"))


@query("a07_area_under_risk", f", {_CURVE} SELECT model, round(avg(errors / rank), 9) AS aurc FROM cv GROUP BY 1")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir).groupBy("model").agg(F.round(F.avg(F.col("errors") / F.col("rank")), 9).alias("aurc"))


_PERCENTILE = """, c AS (SELECT fold, score, count(*) AS n FROM scored WHERE y = 0 GROUP BY ALL)
SELECT a.case_id, round((sum(CASE WHEN c.score < a.score THEN n ELSE 0 END) + sum(CASE WHEN c.score = a.score THEN n ELSE 0 END) / 2) / sum(n), 9) AS percentile FROM scored a JOIN c ON c.fold = a.fold GROUP BY a.case_id"""


@query("a08_mid_percentile", _PERCENTILE)
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir)
    return M.mid_percentile(s.select("case_id", "fold", "score"), s.where("y = 0"), ["fold"]).select("case_id", F.round("percentile", 9).alias("percentile"))


@query(
    "a10_calibration",
    """, e AS (SELECT fold, round(sum(n * abs(c - a)) / sum(n), 9) AS ece, count(*) AS bins_used FROM (SELECT fold, least(floor(score * 5), 4) AS b, count(*) AS n, avg(score) AS c, avg((tactic = prediction)::INT) AS a FROM scored GROUP BY ALL) GROUP BY 1),
c AS (SELECT fold, c, sum(t) AS t, sum(p) AS p, sum(hit * t) AS hit FROM (SELECT fold, tactic AS c, 1 AS t, 0 AS p, (tactic = prediction)::INT AS hit FROM scored UNION ALL SELECT fold, prediction, 0, 1, 0 FROM scored) GROUP BY ALL)
SELECT fold, ece, bins_used, round(sum(hit) / sum(t), 9) AS accuracy, round(avg(2 * hit / (t + p)), 9) AS macro_f1 FROM c JOIN e USING (fold) GROUP BY ALL""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir).withColumn("correct", (F.col("tactic") == F.col("prediction")).cast("int"))
    return _round(M.calibration_error(s, ["fold"]).join(M.class_scores(s, ["fold"]), "fold"), "ece", "accuracy", "macro_f1")


@query("a11_confusion", "SELECT t AS truth, p AS predicted, count(s.case_id) AS n FROM (SELECT DISTINCT tactic AS t FROM scored), (SELECT DISTINCT prediction AS p FROM scored) LEFT JOIN scored s ON s.tactic = t AND s.prediction = p GROUP BY 1, 2")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(V.scored(spark, sf_dir))


@query(
    "a12_cascade",
    f""", {_KTH} SELECT condition, count(*) AS n, sum((accepted = 1 AND score >= rounded AND h % 17 < 8)::INT)::BIGINT AS cascade_n, sum((score >= rounded)::INT)::BIGINT AS margin_n, sum((accepted = 1 AND score >= rounded AND h % 17 < 8 AND correct = 0)::INT)::BIGINT AS cascade_wrong FROM decision JOIN kt USING (fold) GROUP BY 1""",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.broadcast(M.kth_thresholds(V.scored(spark, sf_dir), ["fold"], 0.7).select("fold", "rounded"))
    margin = F.col("score") >= F.col("rounded")
    cascade = (F.col("accepted") == 1) & margin & (F.col("h") % 17 < 8)
    d = V.decision(spark, sf_dir).join(t, "fold")
    return d.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(cascade).alias("cascade_n"), F.count_if(margin).alias("margin_n"), F.count_if(cascade & (F.col("correct") == 0)).alias("cascade_wrong"))


@query(
    "a13_margin_variants",
    f""", {_KTH} SELECT variant, condition, sum((score >= CASE variant WHEN 'calibrated' THEN rounded ELSE retained END AND (variant <> 'with_rule' OR condition <> 'delete_process'))::INT)::BIGINT AS accepted_n FROM decision JOIN kt USING (fold), (SELECT unnest(['calibrated', 'matched', 'with_rule']) AS variant) GROUP BY 1, 2""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.broadcast(M.kth_thresholds(V.scored(spark, sf_dir), ["fold"], 0.7))
    d = M.expand(V.decision(spark, sf_dir).join(t, "fold"), "variant", ["calibrated", "matched", "with_rule"])
    cut = F.when(F.col("variant") == "calibrated", F.col("rounded")).otherwise(F.col("retained"))
    take = (F.col("score") >= cut) & ((F.col("variant") != "with_rule") | (F.col("condition") != "delete_process"))
    return d.groupBy("variant", "condition").agg(F.count_if(take).alias("accepted_n"))


@query(
    "a14_corruption_summary",
    f", {_OUTC} SELECT condition, round(avg(rejection), 6) AS rejection, round(avg(wrong_rate), 6) AS wrong_rate, sum(events_n)::BIGINT AS events_n FROM om WHERE condition <> 'clean' GROUP BY 1",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = family_outcomes(spark, sf_dir).where("condition <> 'clean'")
    return o.groupBy("condition").agg(F.round(F.avg("rejection"), 6).alias("rejection"), F.round(F.avg("wrong_rate"), 6).alias("wrong_rate"), F.sum("events_n").alias("events_n"))


@query(
    "a15_gate_discrimination",
    """, g AS (SELECT fold, score, sum((condition = 'clean')::INT) AS tp, sum((condition <> 'clean')::INT) AS fp FROM (SELECT fold, condition, CASE condition WHEN 'clean' THEN score ELSE floor(score * 90 + 0.5) / 100 END AS score FROM decision WHERE condition IN ('clean', 'replace_context')) GROUP BY ALL),
u AS (SELECT fold::VARCHAR AS fold, score, tp, fp FROM g UNION ALL SELECT 'all', score, sum(tp), sum(fp) FROM g GROUP BY score), c AS (SELECT *, sum(tp) OVER (PARTITION BY fold ORDER BY score DESC) AS tpc FROM u)
SELECT fold, round(sum(fp * (tpc - tp / 2)) / sum(tp) / sum(fp), 9) AS auc, sum(tp)::BIGINT AS clean_n, sum(fp)::BIGINT AS foreign_n FROM c GROUP BY 1""",
)
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.decision(spark, sf_dir).where("condition in ('clean', 'replace_context')")
    clean = F.col("condition") == "clean"
    d = d.select("fold", F.when(clean, F.col("score")).otherwise(F.floor(F.col("score") * 90 + 0.5) / 100).alias("score"), clean.cast("int").alias("y"))
    both = d.withColumn("fold", F.explode(F.array(F.col("fold").cast("string"), F.lit("all"))))
    n = both.groupBy("fold").agg(F.sum("y").alias("clean_n"), F.sum(1 - F.col("y")).alias("foreign_n"))
    return M.curve_areas(both, ["fold"]).join(n, "fold").select("fold", F.round("auc", 9).alias("auc"), "clean_n", "foreign_n")


@query(
    "a16_decision_cost",
    """, m AS (SELECT model, count(*) FILTER (WHERE accepted = 1 AND correct = 0) AS wrong, count(*) FILTER (WHERE accepted = 0) AS abstained FROM decision WHERE condition = 'clean' GROUP BY 1), p AS (SELECT max(wrong) FILTER (WHERE model = 'logistic') - max(wrong) FILTER (WHERE model = 'trees') AS dw, max(abstained) FILTER (WHERE model = 'trees') - max(abstained) FILTER (WHERE model = 'logistic') AS da FROM m)
SELECT model, i, round(wrong + abstained * i / 20, 9) AS cost, round(dw / nullif(da, 0), 9) AS break_even FROM m, p, (SELECT unnest(range(0, 21)) AS i)""",
)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = V.decision(spark, sf_dir).where("condition = 'clean'")
    m = clean.groupBy("model").agg(F.count_if((F.col("accepted") == 1) & (F.col("correct") == 0)).alias("wrong"), F.count_if(F.col("accepted") == 0).alias("abstained"))
    of = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c)))
    p = m.agg((of("logistic", "wrong") - of("trees", "wrong")).alias("dw"), (of("trees", "abstained") - of("logistic", "abstained")).alias("da"))
    grid = M.expand(m.crossJoin(F.broadcast(p)), "i", range(21))
    return grid.select("model", "i", F.round(F.col("wrong") + F.col("abstained") * F.col("i") / 20, 9).alias("cost"), F.round(M.ratio(F.col("dw"), F.col("da")), 9).alias("break_even"))


@query(
    "a18_frozen_comparison",
    "SELECT model, count(*) AS n, round(max(abs(score - round(score, 1))), 9) AS max_difference, sum((prediction <> tactic)::INT)::BIGINT AS mismatches FROM scored GROUP BY 1",
)
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir)
    frozen = s.select("case_id", F.round("score", 1).alias("frozen_score"), F.col("tactic").alias("frozen_prediction"))
    j = s.join(frozen, "case_id")
    return j.groupBy("model").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("score") - F.col("frozen_score"))), 9).alias("max_difference"), F.count_if(F.col("prediction") != F.col("frozen_prediction")).alias("mismatches"))


@query(
    "a19_cohort_outcomes",
    f", lk AS (SELECT DISTINCT h FROM base WHERE k % 13 = 0), oc AS (SELECT condition, {_OUT} FROM decision SEMI JOIN lk USING (h) GROUP BY ALL) SELECT condition, events_n, accepted_n, correct_n, round((accepted_n - correct_n) / nullif(accepted_n, 0), 9) AS risk FROM oc",
)
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = V.base(spark, sf_dir).where("k % 13 = 0").select("h").distinct()
    o = M.outcomes(V.decision(spark, sf_dir).join(cohort, "h", "left_semi"), ["condition"])
    return o.select("condition", "events_n", "accepted_n", "correct_n", F.round("risk", 9).alias("risk"))
