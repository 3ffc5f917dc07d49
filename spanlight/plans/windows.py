"""Queries over windows, gaps and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions import scalars as S
from spanlight.operators import joins as J
from spanlight.operators import windows as W
from spanlight.plans import views as V
from spanlight.plans.registry import query

BUCKET = f"(floor(ts_s / {V.WINDOW}) * {V.WINDOW})::BIGINT"
PROTOCOLS = ("ARP", "ICMP", "TCP", "UDP")
BANDS = {"well_known": (1, 1023), "registered": (1024, 49151), "dynamic": (49152, 65535)}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of both views."""
    flow = V.flow(spark, sf_dir).where("label = 1").selectExpr("ts_s", "tactic", "'network' AS view", "action AS detail", "'' AS type", "'' AS pid")
    pid = "CASE WHEN src LIKE 'p%' THEN cast(1000 + cast(substr(src, 2) AS bigint) AS string) ELSE '' END AS pid"
    prov = V.prov_edge(spark, sf_dir).where("label = 1").selectExpr("ts_s", "tactic", "'provenance' AS view", "operation AS detail", "relation AS type", pid)
    return flow.unionByName(prov)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.case_summary(observations(spark, sf_dir), V.GAP).withColumn("anchor", F.coalesce("network_start", "start_s"))


def _shares() -> dict:
    port = F.col("dst_port")
    out = {f"protocol_{p.lower()}": F.col("protocol") == p for p in PROTOCOLS}
    out |= {f"port_{p}": port == p for p in V.PORTS}
    return out | {f"band_{b}": port.between(*r) for b, r in BANDS.items()}


def _share_sql() -> str:
    out = [f"count(*) FILTER (WHERE protocol = '{p}') / count(*) AS protocol_{p.lower()}_share" for p in PROTOCOLS]
    out += [f"count(*) FILTER (WHERE dst_port = {p}) / count(*) AS port_{p}_share" for p in V.PORTS]
    out += [f"count(*) FILTER (WHERE dst_port BETWEEN {a} AND {b}) / count(*) AS band_{n}_share" for n, (a, b) in BANDS.items()]
    return ", ".join(out)


_STATS = "count(*) AS row_count, round(sum(size), 6) AS size_sum, round(avg(size), 8) AS size_mean, round(sqrt(greatest(0, avg(size * size) - avg(size) * avg(size))), 6) AS size_std, max(size) AS size_max, sum(flag) / count(*) AS flag_mean"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"size_sum": F.round("size_sum", 6), "size_mean": F.round("size_mean", 8), "size_std": F.round("size_std", 6)})


@query("w01_window_profile", f"SELECT {BUCKET} AS window_start, {_STATS}, {_share_sql()} FROM flow GROUP BY 1")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.window_profile(V.flow(spark, sf_dir), V.WINDOW, ["size"], ["flag"], _shares()))


@query(
    "w02_value_spread",
    f"""SELECT window_start, dimension, count(*) AS distinct_values, round(sum(n * n) / (sum(n) * sum(n)), 9) AS hhi FROM (
  SELECT {BUCKET} AS window_start, dimension, value, count(*) AS n FROM (SELECT ts_s, unnest(['src_ip', 'dst_ip', 'src_port', 'dst_port']) AS dimension,
    unnest([src_ip, dst_ip, src_port::VARCHAR, dst_port::VARCHAR]) AS value FROM flow) GROUP BY ALL) GROUP BY 1, 2""",
)
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.value_spread(V.flow(spark, sf_dir), [W.bucket(F.col("ts_s"), V.WINDOW).alias("window_start")], ["src_ip", "dst_ip", "src_port", "dst_port"])
    return out.withColumn("hhi", F.round("hhi", 9))


@query(
    "w03_vocabulary_shares",
    f"SELECT {BUCKET} AS window_start, count(*) AS row_count, {_share_sql()} FROM flow WHERE label = 1 GROUP BY 1",
)
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_profile(V.flow(spark, sf_dir).where("label = 1"), V.WINDOW, [], [], _shares())


_DENSE = f""", w AS (SELECT {BUCKET} AS window_start, count(*) AS row_count, round(sum(size), 6) AS size_sum FROM flow GROUP BY 1)
SELECT s.window_start, coalesce(row_count, 0) AS row_count, coalesce(size_sum, 0) AS size_sum
FROM (SELECT unnest(generate_series(min(window_start), max(window_start), {V.WINDOW})) AS window_start FROM w) s LEFT JOIN w USING (window_start)"""


@query("w04_dense_windows", _DENSE)
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.window_profile(V.flow(spark, sf_dir), V.WINDOW, ["size"], [], {}).select("window_start", "row_count", F.round("size_sum", 6).alias("size_sum"))
    return W.dense(out, V.WINDOW)


@query(
    "w05_window_truth",
    f"""SELECT window_start, sum(n)::BIGINT AS positives, string_agg(tactic || '=' || n, ',' ORDER BY tactic || '=' || n) AS tactics FROM (
  SELECT {BUCKET} AS window_start, tactic, count(*) AS n FROM flow WHERE label = 1 GROUP BY ALL) GROUP BY 1""",
)
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.flow(spark, sf_dir).where("label = 1").groupBy(W.bucket(F.col("ts_s"), V.WINDOW).alias("window_start"), "tactic").agg(F.count("*").alias("n"))
    return n.groupBy("window_start").agg(F.sum("n").alias("positives"), W.text_map(F.col("tactic"), F.col("n")).alias("tactics"))


_CASE_WINDOWS = f"cw AS (SELECT case_id, tactic, unnest(generate_series((floor(start_s / {V.WINDOW}) * {V.WINDOW})::BIGINT, (floor(end_s / {V.WINDOW}) * {V.WINDOW})::BIGINT, {V.WINDOW})) AS window_start FROM cases)"


def case_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.touched_windows(cases(spark, sf_dir), V.WINDOW, "start_s", "end_s").select("case_id", "tactic", "window_start")


@query("w06_case_windows", f", {_CASE_WINDOWS} SELECT window_start, string_agg(case_id, ',' ORDER BY case_id) AS case_ids, count(DISTINCT tactic) AS tactics FROM cw GROUP BY 1")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_windows(spark, sf_dir).groupBy("window_start").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("case_ids"), F.countDistinct("tactic").alias("tactics"))


@query(
    "w07_window_audit",
    f""", {_CASE_WINDOWS}, w AS (SELECT {BUCKET} AS window_start, count(*) AS n, sum(label) AS pos FROM flow GROUP BY 1),
s AS (SELECT unnest(generate_series(min(window_start), max(window_start), {V.WINDOW})) AS window_start FROM w), m AS (SELECT window_start, count(*) AS c FROM cw GROUP BY 1)
SELECT count(*) AS windows, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS empty_windows, count(*) FILTER (WHERE pos > 0) AS positive_windows,
  count(*) FILTER (WHERE pos > 0 AND c IS NULL) AS positive_unmapped, count(c) AS mapped_windows, (SELECT count(DISTINCT case_id) FROM cw JOIN s USING (window_start)) AS mapped_cases
FROM s LEFT JOIN w USING (window_start) LEFT JOIN m USING (window_start)""",
)
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.flow(spark, sf_dir).groupBy(W.bucket(F.col("ts_s"), V.WINDOW).alias("window_start")).agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    spine, cw = W.dense(w, V.WINDOW), case_windows(spark, sf_dir)
    m = cw.groupBy("window_start").agg(F.count("*").alias("c"))
    counts = spine.join(m, "window_start", "left").agg(
        F.count("*").alias("windows"), F.count_if(F.col("n") == 0).alias("empty_windows"), F.count_if(F.col("pos") > 0).alias("positive_windows"),
        F.count_if((F.col("pos") > 0) & F.col("c").isNull()).alias("positive_unmapped"), F.count("c").alias("mapped_windows"),
    )
    return counts.crossJoin(cw.join(spine, "window_start", "left_semi").agg(F.countDistinct("case_id").alias("mapped_cases")))


@query(
    "w08_alert_summary",
    f""", a AS (SELECT DISTINCT (floor(anchor / {V.WINDOW}) * {V.WINDOW})::BIGINT AS window_start FROM anchored),
v AS (SELECT {BUCKET} AS window_start, dst_port AS value, count(*) AS n FROM flow GROUP BY ALL), r AS (SELECT v.*, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, value) AS place FROM v SEMI JOIN a USING (window_start))
SELECT window_start, place, value AS dst_port, n FROM r WHERE place <= 5""",
)
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = cases(spark, sf_dir).select(W.bucket(F.col("anchor"), V.WINDOW).alias("window_start")).distinct()
    flow = V.flow(spark, sf_dir).withColumn("window_start", W.bucket(F.col("ts_s"), V.WINDOW)).join(anchors, "window_start", "left_semi")
    counts = flow.groupBy("window_start", "dst_port").agg(F.count("*").alias("n"))
    return J.top_k(counts, ["window_start"], [F.desc("n"), F.asc("dst_port")], 5, "place").select("window_start", "place", "dst_port", "n")


@query("w09_gap_clusters", "SELECT case_id, tactic, start_s, end_s, rows_n FROM cases")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", "tactic", "start_s", "end_s", "rows_n")


@query(
    "w10_cluster_summary",
    """, d AS (SELECT tactic || '_' || lpad(n::VARCHAR, 4, '0') AS case_id, string_agg(DISTINCT pid, ',' ORDER BY pid) FILTER (WHERE pid <> '') AS pids, count(DISTINCT detail) AS details FROM numbered GROUP BY 1)
SELECT case_id, round(end_s - start_s, 6) AS duration_s, network_n, provenance_n, network_start, network_end, provenance_start, provenance_end,
  CASE WHEN network_n > 0 AND provenance_n > 0 THEN 'both' WHEN network_n > 0 THEN 'network' ELSE 'provenance' END AS views, coalesce(pids, '') AS pids, details FROM cases JOIN d USING (case_id)""",
)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = W.gap_clusters(observations(spark, sf_dir), ["tactic"], "ts_s", V.GAP).withColumn("case_id", F.concat_ws("_", "tactic", F.lpad(F.col("cluster_n").cast("string"), 4, "0")))
    pids = F.array_join(F.array_sort(F.collect_set(F.when(F.col("pid") != "", F.col("pid")))), ",")
    details = c.groupBy("case_id").agg(pids.alias("pids"), F.countDistinct("detail").alias("details"))
    views = F.when((F.col("network_n") > 0) & (F.col("provenance_n") > 0), "both").when(F.col("network_n") > 0, "network").otherwise("provenance")
    return cases(spark, sf_dir).join(details, "case_id").select(
        "case_id", F.round(F.col("end_s") - F.col("start_s"), 6).alias("duration_s"), "network_n", "provenance_n", "network_start", "network_end", "provenance_start", "provenance_end", views.alias("views"), "pids", "details"
    )


GAPS = (1800, 3600, 7200, 14400)


@query(
    "w11_gap_sweep",
    f""", g AS (SELECT tactic, gap, count(*) FILTER (WHERE step > gap) + 1 AS clusters FROM (SELECT tactic, ts_s - lag(ts_s) OVER (PARTITION BY tactic ORDER BY ts_s) AS step FROM obs), (SELECT unnest({list(GAPS)}) AS gap) GROUP BY ALL)
SELECT tactic, gap, clusters FROM g UNION ALL SELECT 'all', gap, sum(clusters)::BIGINT FROM g GROUP BY gap""",
)
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.gap_sweep(observations(spark, sf_dir), "tactic", "ts_s", GAPS)


@query("w12_view_coverage", "SELECT CASE WHEN network_n > 0 AND provenance_n > 0 THEN 'both' WHEN network_n > 0 THEN 'network' ELSE 'provenance' END AS views, count(*) AS cases_n FROM cases GROUP BY 1")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = F.when((F.col("network_n") > 0) & (F.col("provenance_n") > 0), "both").when(F.col("network_n") > 0, "network").otherwise("provenance")
    return cases(spark, sf_dir).groupBy(views.alias("views")).agg(F.count("*").alias("cases_n"))


@query(
    "w13_view_agreement",
    """, s AS (SELECT unnest([900, 3600, 7200]) AS size), w AS (SELECT size, floor(ts_s / size)::BIGINT AS w, list_distinct(list(tactic) FILTER (WHERE view = 'network')) AS a, list_distinct(list(tactic) FILTER (WHERE view = 'provenance')) AS b FROM obs, s GROUP BY ALL)
SELECT size, count(*) AS union_windows, count(*) FILTER (WHERE len(a) > 0 AND len(b) > 0) AS paired, count(*) FILTER (WHERE len(a) > 0 AND len(b) > 0) / count(*) AS jaccard,
  count(*) FILTER (WHERE len(a) > 0 AND len(b) > 0 AND list_has_any(a, b)) AS agreeing FROM w GROUP BY 1""",
)
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.view_agreement(observations(spark, sf_dir), (900, 3600, 7200))


@query(
    "w14_tactic_timeline",
    """, c AS (SELECT tactic, count(*) AS clusters FROM cases GROUP BY 1)
SELECT o.tactic, epoch_us(date_trunc('day', make_timestamp((ts_s * 1000000)::BIGINT)))::BIGINT // 1000000 AS day_s, count(*) AS events_n, any_value(c.clusters) AS clusters, min(ts_s) AS first_s, max(ts_s) AS last_s FROM obs o JOIN c USING (tactic) GROUP BY 1, 2""",
)
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    clusters = cases(spark, sf_dir).groupBy("tactic").agg(F.count("*").alias("clusters"))
    days = o.groupBy("tactic", W.bucket(F.col("ts_s"), W.DAY).alias("day_s")).agg(F.count("*").alias("events_n"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    return days.join(clusters, "tactic")


@query(
    "w15_label_reconciliation",
    """SELECT 'node' AS part, type AS kind, count(*) AS rows_n, sum(label)::BIGINT AS labelled FROM prov_node GROUP BY 2
UNION ALL SELECT 'edge', relation || ':' || tactic, count(*), sum(label)::BIGINT FROM prov_edge GROUP BY 2""",
)
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = V.prov_node(spark, sf_dir).select(F.lit("node").alias("part"), F.col("type").alias("kind"), "label")
    edges = V.prov_edge(spark, sf_dir).select(F.lit("edge").alias("part"), F.concat_ws(":", "relation", "tactic").alias("kind"), "label")
    return nodes.union(edges).groupBy("part", "kind").agg(F.count("*").alias("rows_n"), F.sum("label").alias("labelled"))


_MERGED = f"""i AS (SELECT tactic, start_s - {V.RADIUS} AS a, end_s + {V.RADIUS} AS b FROM cases),
o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY tactic ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY tactic ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o), merged AS (SELECT tactic, min(a) AS a, max(b) AS b FROM n GROUP BY tactic, g)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = cases(spark, sf_dir).select("tactic", (F.col("start_s") - V.RADIUS).alias("a"), (F.col("end_s") + V.RADIUS).alias("b"))
    return W.merge_intervals(padded, ["tactic"], "a", "b")


@query("w16_merged_intervals", f", {_MERGED} SELECT tactic, count(*) AS intervals, round(sum(b - a), 6) AS seconds FROM merged GROUP BY 1")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).groupBy("tactic").agg(F.count("*").alias("intervals"), F.round(F.sum(F.col("b") - F.col("a")), 6).alias("seconds"))


BUDGETS = (0.05, 0.1, 0.2)


@query(
    "w17_retention_frontier",
    f""", al AS (SELECT h, max(score) AS score FROM scored GROUP BY 1), q AS (SELECT budget, h, row_number() OVER (PARTITION BY budget ORDER BY score DESC, h) AS place, count(*) OVER (PARTITION BY budget) AS total FROM al, (SELECT unnest({list(BUDGETS)}::DOUBLE[]) AS budget)),
cap AS (SELECT min(ts_s) AS lo, max(ts_s) AS hi, count(*) AS rows_n, sum(size) AS bytes FROM flow),
i AS (SELECT budget, greatest(lo, h * 3600 - {V.RADIUS}) AS a, least(hi, h * 3600 + {V.RADIUS}) AS b FROM q, cap WHERE place <= ceil(budget * total)),
o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY budget ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY budget ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o), m AS (SELECT budget, min(a) AS a, max(b) AS b FROM n GROUP BY budget, g),
t AS (SELECT budget, count(*) AS intervals, sum(b - a) AS seconds FROM m GROUP BY 1), k AS (SELECT budget, count(*) AS rows_n, sum(size) AS bytes FROM flow JOIN m ON ts_s BETWEEN a AND b GROUP BY 1)
SELECT t.budget, t.intervals, round(t.seconds / (hi - lo), 9) AS time_share, k.rows_n / cap.rows_n AS row_share, round(k.bytes / cap.bytes, 9) AS byte_share FROM t JOIN k USING (budget), cap""",
)
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = V.flow(spark, sf_dir).select("ts_s", "size")
    alerts = V.scored(spark, sf_dir).groupBy("h").agg(F.max("score").alias("score"))
    return J.retention(flow, alerts, BUDGETS, V.RADIUS)


@query("w18_points_inside", f", {_MERGED} SELECT tactic, count(*) AS rows_n, round(sum(size), 4) AS bytes FROM flow f WHERE EXISTS (SELECT 1 FROM merged m WHERE m.tactic = f.tactic AND f.ts_s BETWEEN m.a AND m.b) GROUP BY 1")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = W.points_inside(V.flow(spark, sf_dir).select("tactic", "ts_s", "size"), merged(spark, sf_dir), ["tactic"], "ts_s", "a", "b", V.WINDOW)
    return inside.groupBy("tactic").agg(F.count("*").alias("rows_n"), F.round(F.sum("size"), 4).alias("bytes"))


@query(
    "f08_tactics_and_ids",
    """SELECT tactic, 'w_' || substr(sha256(tactic || '|' || action), 1, 20) AS id, (('0x' || substr(sha256(tactic || '|' || action), 1, 16))::UBIGINT % 7)::BIGINT AS bucket, count(*) AS n FROM flow GROUP BY tactic, action""",
)
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = V.flow(spark, sf_dir).groupBy("tactic", "action").agg(F.count("*").alias("n"))
    return keyed.select("tactic", S.opaque_id("w", F.col("tactic"), F.col("action")).alias("id"), S.stable_bucket(F.concat_ws("|", "tactic", "action"), 7).alias("bucket"), "n")
