"""Queries over splits and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions import scalars as S
from spanlight.operators import resample as B
from spanlight.operators import splits as P
from spanlight.operators import windows as W
from spanlight.plans import views as V
from spanlight.plans.registry import query
from spanlight.plans.windows import cases

E = V.EMBARGO
_GROUPS = f"""eo AS (SELECT *, CASE WHEN start_s - {E} <= max(end_s + {E}) OVER (ORDER BY start_s, end_s, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM cases),
eg AS (SELECT *, sum(fresh) OVER (ORDER BY start_s, end_s, case_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_n FROM eo)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.embargo_groups(cases(spark, sf_dir).withColumn("campaign", F.lit("c")), ["campaign"], E)


def group_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).groupBy("campaign", "group_n", "tactic").agg(F.count("*").alias("n"))


@query("p01_embargo_groups", f", {_GROUPS} SELECT group_n, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS cases_n, string_agg(case_id, ',' ORDER BY case_id) AS case_ids FROM eg GROUP BY 1")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).groupBy("group_n").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("cases_n"), F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("case_ids"))


@query("p02_tactic_support", "SELECT tactic, count(*) AS cases_n, (count(*) >= 8)::INT AS supported FROM cases GROUP BY 1")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("tactic").agg(F.count("*").alias("cases_n"), (F.count("*") >= 8).cast("int").alias("supported"))


@query("p03_stratified_folds")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified_folds(group_tactics(spark, sf_dir), "campaign")


@query("p04_calibration_groups")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = p03(spark, sf_dir)
    other = folds.crossJoin(F.broadcast(folds.select(F.col("fold").alias("test_fold")).distinct())).where("fold <> test_fold").select("group_n", "test_fold")
    rows = group_tactics(spark, sf_dir).join(other, "group_n").withColumn("fold", F.col("test_fold"))
    return P.calibration_groups(rows, ["fold"])


@query(
    "p05_membership",
    f""", {_GROUPS}, m AS (SELECT case_id, tactic, group_n, f AS fold, CASE WHEN group_n % 3 = f - 1 THEN 'test' WHEN group_n % 5 = 0 THEN 'calibration' ELSE 'train' END AS part FROM eg, (SELECT unnest([1, 2, 3]) AS f))
SELECT fold, part, count(*) AS cases_n, count(DISTINCT group_n) AS groups_n, count(DISTINCT tactic) AS tactics_n FROM m GROUP BY ALL""",
)
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    part = F.when(F.col("group_n") % 3 == F.col("fold") - 1, "test").when(F.col("group_n") % 5 == 0, "calibration").otherwise("train")
    return g.groupBy("fold", part.alias("part")).agg(F.count("*").alias("cases_n"), F.countDistinct("group_n").alias("groups_n"), F.countDistinct("tactic").alias("tactics_n"))


@query(
    "p06_window_blocks",
    f""", {_GROUPS}, gr AS (SELECT group_n, min(start_s) AS a, max(end_s) AS b FROM eg GROUP BY 1), ow AS (SELECT blk, min(group_n) AS group_n FROM (SELECT group_n, unnest(generate_series(floor(a / 900)::BIGINT, floor(b / 900)::BIGINT)) AS blk FROM gr) GROUP BY 1),
bl AS (SELECT DISTINCT floor(ts_s / 900)::BIGINT AS blk FROM flow), p AS (SELECT blk, group_n, ('0x' || substr(sha256('block|' || blk), 1, 16))::UBIGINT % 15 AS u FROM bl LEFT JOIN ow USING (blk))
SELECT coalesce(CASE group_n % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' WHEN 2 THEN 'calibration' END, CASE WHEN u % 3 = 0 THEN 'test' WHEN (u // 3) % 5 = 0 THEN 'calibration' ELSE 'train' END) AS part, (group_n IS NOT NULL)::INT AS owned, count(*) AS blocks_n, sum(blk)::BIGINT AS digest FROM p GROUP BY ALL""",
)
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).groupBy("group_n").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b"))
    owners = W.touched_windows(g, 900, "a", "b").groupBy((F.col("window_start") / 900).cast("bigint").alias("blk")).agg(F.min("group_n").alias("group_n"))
    blocks = V.flow(spark, sf_dir).select(F.floor(F.col("ts_s") / 900).alias("blk")).distinct().join(owners, "blk", "left")
    u = S.stable_bucket(F.concat_ws("|", F.lit("block"), F.col("blk").cast("string")), 15)
    owned = F.when(F.col("group_n") % 3 == 0, "test").when(F.col("group_n") % 3 == 1, "train").when(F.col("group_n") % 3 == 2, "calibration")
    part = F.coalesce(owned, P.background_partition(u))
    return blocks.groupBy(part.alias("part"), F.col("group_n").isNotNull().cast("int").alias("owned")).agg(F.count("*").alias("blocks_n"), F.sum("blk").alias("digest"))


@query(
    "p07_repeated_folds",
    f""", {_GROUPS}, sp AS (SELECT tactic, count(*) AS n FROM cases GROUP BY 1), gl AS (SELECT group_n, arg_min(tactic, (n, tactic)) AS label FROM eg JOIN sp USING (tactic) GROUP BY 1)
SELECT seed, group_n, label, ((row_number() OVER (PARTITION BY seed, label ORDER BY md5(concat_ws('|', seed, group_n)))) % 3 + 1)::INT AS fold FROM gl, (SELECT unnest([1, 2, 3]) AS seed)""",
)
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = groups(spark, sf_dir)
    support = g.groupBy("tactic").agg(F.count("*").alias("n"))
    label = g.join(support, "tactic").groupBy("group_n").agg(F.min_by("tactic", F.struct("n", "tactic")).alias("label"))
    seeded = label.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    order = Window.partitionBy("seed", "label").orderBy(F.md5(F.concat_ws("|", "seed", "group_n")))
    return seeded.select("seed", "group_n", "label", (F.row_number().over(order) % 3 + 1).cast("int").alias("fold"))


@query("p08_family_folds")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlight.plans.graph import entities

    e = entities(spark, sf_dir).where("kind = 'process' and label = 1")
    family = e.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("family"))
    return P.family_folds(family.groupBy("family").agg(F.count("*").alias("n")).withColumn("campaign", F.lit("c")), "campaign")


#: Replicates of every resampling query.
R = 10_000


def _weights(unit: str, src: str, salt: str) -> str:
    return f"""pl AS (SELECT {unit} AS unit, row_number() OVER (ORDER BY {unit}) - 1 AS place FROM (SELECT DISTINCT {unit} FROM {src})), nn AS (SELECT count(*) AS n FROM pl),
hs AS (SELECT b, j, n, md5(concat_ws('|', '{salt}', b, j)) AS h FROM nn, (SELECT unnest(range(0, {R})) AS b), (SELECT unnest(range(0, (SELECT (n + 3) // 4 FROM nn))) AS j)),
dr AS (SELECT b AS replicate, ('0x' || substr(h, (8 * q + 1)::INT, 8))::BIGINT % n AS place FROM hs, (SELECT unnest(range(0, 4)) AS q) WHERE 4 * j + q < n),
wt AS (SELECT replicate, unit, count(*) AS w FROM dr JOIN pl USING (place) GROUP BY ALL)"""


_SUMS = "sm AS (SELECT group_id, model, sum(accepted * (1 - correct))::BIGINT AS wrong, sum(accepted)::BIGINT AS accepted_n, count(*) AS events_n FROM decision WHERE condition = 'clean' GROUP BY ALL)"


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.decision(spark, sf_dir).where("condition = 'clean'")
    return d.groupBy("group_id", "model").agg(F.sum(F.col("accepted") * (1 - F.col("correct"))).alias("wrong"), F.sum("accepted").alias("accepted_n"), F.count("*").alias("events_n"))


def _boot(num: str, den: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""{_SUMS}, {_weights('group_id', 'sm', 'boot')}, rp AS (SELECT {k}replicate, sum(w * {num}) / nullif(sum(w * {den}), 0) AS x FROM wt JOIN sm ON sm.group_id = wt.unit GROUP BY ALL),
pt AS (SELECT {k}sum({num}) / sum({den}) AS estimate FROM sm GROUP BY ALL), iv AS (SELECT {k}quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper, avg((x > 0)::INT) AS share_positive FROM rp GROUP BY ALL)"""


_BOOT_OUT = "round(estimate, 9) AS estimate, round(lower, 9) AS lower, round(upper, 9) AS upper, round(share_positive, 9) AS share_positive"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("estimate", "lower", "upper", "share_positive")})


@query("b01_mean_interval", f", {_boot('wrong', 'events_n')} SELECT {_BOOT_OUT} FROM pt, iv")
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean_interval(spark, sf_dir)


def _mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.bootstrap_ratio(sums(spark, sf_dir), "group_id", "wrong", "events_n", R, "boot"))


@query("b02_risk_interval", f", {_boot('wrong', 'accepted_n', 'model')} SELECT model, {_BOOT_OUT} FROM pt JOIN iv USING (model)")
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk_interval(spark, sf_dir)


def _risk_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.bootstrap_ratio(sums(spark, sf_dir), "group_id", "wrong", "accepted_n", R, "boot", ["model"]))


@query(
    "b03_group_interval",
    f""", {_GROUPS}, sm AS (SELECT group_n, sum(rows_n)::BIGINT AS a, sum(network_n)::BIGINT AS b FROM eg GROUP BY 1), {_weights('group_n', 'sm', 'groups')}, rp AS (SELECT replicate, sum(w * b) / sum(w * a) AS x FROM wt JOIN sm ON sm.group_n = wt.unit GROUP BY ALL)
SELECT round((SELECT sum(b) / sum(a) FROM sm), 9) AS estimate, round(quantile_cont(x, 0.025), 9) AS lower, round(quantile_cont(x, 0.975), 9) AS upper, round(avg((x > 0)::INT), 9) AS share_positive FROM rp""",
)
def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_interval(spark, sf_dir)


def _group_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).groupBy("group_n").agg(F.sum("rows_n").alias("a"), F.sum("network_n").alias("b"))
    return _shown(B.bootstrap_ratio(g, "group_n", "b", "a", R, "groups"))


@query(
    "b04_reselected_risk",
    f""", tr AS (SELECT group_id, max(score) AS score, max((tactic <> prediction)::INT) AS wrong FROM scored GROUP BY 1), {_weights('group_id', 'tr', 'top')},
j AS (SELECT replicate, wrong, w, sum(w) OVER (PARTITION BY replicate ORDER BY score DESC, unit ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY replicate) AS total FROM wt JOIN tr ON tr.group_id = wt.unit),
u AS (SELECT replicate, wrong, greatest(0, least(w, greatest(1, round_even(total * 0.5::DOUBLE, 0)) - (upto - w))) AS used FROM j) SELECT replicate, round(sum(used * wrong) / sum(used), 9) AS risk FROM u GROUP BY 1""",
)
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reselected_risk(spark, sf_dir)


def _reselected_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.scored(spark, sf_dir).groupBy("group_id").agg(F.max("score").alias("score"), F.max((F.col("tactic") != F.col("prediction")).cast("int")).alias("wrong"))
    return B.top_share_risk(rows, "group_id", "score", "wrong", 0.5, R, "top").withColumn("risk", F.round("risk", 9))


_PAIR = """pr AS (SELECT case_id, max(correct) FILTER (WHERE condition = 'clean') AS a, max(correct) FILTER (WHERE condition = 'shift_time') AS b FROM decision GROUP BY 1), pc AS (SELECT count(*) FILTER (WHERE a > b) AS only_a, count(*) FILTER (WHERE b > a) AS only_b FROM pr)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.decision(spark, sf_dir)
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("correct")))
    return d.groupBy("case_id").agg(of("clean").alias("a"), of("shift_time").alias("b"))


_MCNEMAR = f""", {_PAIR} SELECT only_a, only_b, round(least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))), 9) AS p FROM pc"""


@query("b05_mcnemar", _MCNEMAR)
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pairs(spark, sf_dir).agg(F.count_if(F.col("a") > F.col("b")).alias("only_a"), F.count_if(F.col("b") > F.col("a")).alias("only_b"))
    return c.select("only_a", "only_b", F.round(B.mcnemar_p(F.col("only_a"), F.col("only_b")), 9).alias("p"))


@query(
    "b06_sign_flip",
    f""", {_PAIR}, df AS (SELECT a - b AS d FROM pr WHERE a <> b), sz AS (SELECT abs(d)::BIGINT AS size, count(*) AS n FROM df GROUP BY 1), sn AS (SELECT (SELECT sum(d) FROM df)::BIGINT AS seen, 2 * (SELECT sum(size * n) FROM sz)::BIGINT + 1 AS whole),
fq AS (SELECT k, any_value(seen) AS seen, any_value(whole) AS whole, exp(sum(n * ln(abs(cos(2 * pi() * ((k * size) % whole) / whole))))) * CASE WHEN sum(CASE WHEN cos(2 * pi() * ((k * size) % whole) / whole) < 0 THEN n ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END AS phi
  FROM sn, (SELECT unnest(range(0, (SELECT whole FROM sn))) AS k), sz GROUP BY k)
SELECT any_value(seen) AS sum, round(CASE WHEN any_value(seen) = 0 THEN 1 ELSE least(1, greatest(0, 1 - sum(phi * CASE WHEN k = 0 THEN 2 * abs(seen) - 1 ELSE sin(pi() * ((k * (2 * abs(seen) - 1)) % (2 * whole)) / whole) / sin(pi() * k / whole) END) / any_value(whole))) END, 9) + 0.0 AS p FROM fq""",
)
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sign_flip(pairs(spark, sf_dir).select((F.col("a") - F.col("b")).alias("d"))).withColumn("p", F.round("p", 9) + F.lit(0.0))


@query(
    "b07_paired_effect",
    "SELECT group_id % 7 AS cohort, round(avg(a - b), 9) AS effect, count(*) AS cases_n FROM (SELECT group_id, avg(correct) FILTER (WHERE condition = 'clean') AS a, avg(correct) FILTER (WHERE condition = 'half_delete') AS b FROM decision GROUP BY 1) GROUP BY 1",
)
def b07(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.avg(F.when(F.col("condition") == c, F.col("correct")))
    per = V.decision(spark, sf_dir).groupBy("group_id").agg(of("clean").alias("a"), of("half_delete").alias("b"))
    return per.groupBy((F.col("group_id") % 7).alias("cohort")).agg(F.round(F.avg(F.col("a") - F.col("b")), 9).alias("effect"), F.count("*").alias("cases_n"))


@query("b08_repeat_summary", "SELECT model, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS std, round(min(m), 9) AS least, round(max(m), 9) AS most FROM (SELECT model, seed, fold, avg((tactic = prediction)::INT) AS m FROM scored GROUP BY ALL) GROUP BY 1")
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = V.scored(spark, sf_dir).groupBy("model", "seed", "fold").agg(F.avg((F.col("tactic") == F.col("prediction")).cast("int")).alias("m"))
    r = lambda f, n: F.round(f("m"), 9).alias(n)
    return per.groupBy("model").agg(r(F.avg, "mean"), r(F.stddev_samp, "std"), r(F.min, "least"), r(F.max, "most"))
