"""Queries over joins between views and over candidate graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions import scalars as S
from spanlight.operators import graph as G
from spanlight.operators import joins as J
from spanlight.operators import windows as W
from spanlight.plans import views as V
from spanlight.plans.registry import query
from spanlight.plans.windows import cases, observations
from spanlight.sources.io import stored

R = V.RADIUS
_REL = f"rel AS (SELECT c.case_id, c.tactic AS case_tactic, c.anchor, e.row_id, e.ts_s, e.src, e.dst, e.relation, e.operation, e.label, e.tactic, e.ts_s - c.anchor AS delta FROM anchored c JOIN prov_edge e ON abs(e.ts_s - c.anchor) <= {R})"
_ENDS = "ends AS (SELECT *, src AS id, dst AS other, 1 AS o FROM rel UNION ALL SELECT *, dst, src, 0 FROM rel)"
_KIND = "CASE WHEN type = 'Process' THEN 'process' WHEN subtype = 'network socket' THEN 'socket' ELSE subtype END"
_ENT = f"""ent AS (SELECT case_id, e.id, {_KIND} AS kind, n.label, sum(1 - o)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, min(abs(delta)) AS closest, count(*) AS incident,
  greatest(0, 1 - min(abs(delta)) / {R}) AS proximity FROM ends e JOIN prov_node n ON n.id = e.id GROUP BY ALL)"""
_GRAPH = f"{_REL}, {_ENDS}, {_ENT}"


def relations(spark: SparkSession, sf_dir: str, radius: float = R, offset: float = 0.0) -> DataFrame:
    c = cases(spark, sf_dir).select("case_id", F.col("tactic").alias("case_tactic"), "anchor")
    return stored(G.case_relations(c, V.prov_edge(spark, sf_dir), radius, offset))


def entities(spark: SparkSession, sf_dir: str, rel: DataFrame | None = None) -> DataFrame:
    """``rel`` are the relations, where the caller has them already."""
    return G.entity_features(relations(spark, sf_dir) if rel is None else rel, V.prov_node(spark, sf_dir), R)


@query(
    "j01_observations",
    "SELECT view, tactic, detail, count(*) AS n, min(ts_s) AS first_s FROM obs GROUP BY ALL",
)
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("view", "tactic", "detail").agg(F.count("*").alias("n"), F.min("ts_s").alias("first_s"))


@query(
    "j02_nearest_distance",
    """, d AS (SELECT a.view, (SELECT min(abs(a.ts_s - b.ts_s)) FROM obs b WHERE b.tactic = a.tactic AND b.view <> a.view) AS distance FROM obs a)
SELECT view, count(*) AS n, round(quantile_cont(distance, 0.5), 6) AS median, round(quantile_cont(distance, 0.9), 6) AS p90, round(quantile_cont(distance, 0.95), 6) AS p95, max(distance) AS largest FROM d WHERE distance IS NOT NULL GROUP BY 1""",
)
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = J.nearest_distance(observations(spark, sf_dir), "tactic", "ts_s", "view", "network", "provenance")
    p = lambda q: F.round(F.percentile("distance", F.lit(q)), 6)
    return d.groupBy("view").agg(F.count("*").alias("n"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max("distance").alias("largest"))


@query("j03_anchors", "SELECT case_id, anchor, (network_start IS NULL)::INT AS from_start FROM anchored")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", "anchor", F.col("network_start").isNull().cast("int").alias("from_start"))


@query("j04_case_relations", f", {_REL} SELECT case_id, row_id, src, dst, round(delta, 6) AS delta FROM rel")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).select("case_id", "row_id", "src", "dst", F.round("delta", 6).alias("delta"))


@query(
    "j05_offset_sweep",
    f"SELECT o AS offset_s, count(*) AS relations_n, count(DISTINCT case_id) AS cases_n FROM anchored, (SELECT unnest({list(V.OFFSETS)}) AS o), prov_edge WHERE abs(prov_edge.ts_s - (anchor - o)) <= {R} GROUP BY 1",
)
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir).select("case_id", "anchor")
    found = G.offset_relations(c, V.prov_edge(spark, sf_dir).select("ts_s"), R, [float(o) for o in V.OFFSETS])
    return found.groupBy(F.col("offset_s").cast("int").alias("offset_s")).agg(F.count("*").alias("relations_n"), F.countDistinct("case_id").alias("cases_n"))


RADII = (600, 1800, 3600)


@query(
    "j06_radius_sweep",
    f""", p AS (SELECT radius, case_id, count(*) AS n, max(label) AS hit FROM anchored, (SELECT unnest({list(RADII)}) AS radius), prov_edge WHERE abs(prov_edge.ts_s - anchor) <= radius GROUP BY 1, 2)
SELECT radius, count(*) AS cases_n, sum(n)::BIGINT AS relations_n, sum(hit)::BIGINT AS with_truth FROM p GROUP BY 1""",
)
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir).select("case_id", "anchor")
    widest = G.case_relations(c, V.prov_edge(spark, sf_dir), max(RADII)).withColumn("radius", F.explode(F.array(*map(F.lit, RADII)))).where(F.abs("delta") <= F.col("radius"))
    per = widest.groupBy("radius", "case_id").agg(F.count("*").alias("n"), F.max("label").alias("hit"))
    return per.groupBy("radius").agg(F.count("*").alias("cases_n"), F.sum("n").alias("relations_n"), F.sum("hit").cast("bigint").alias("with_truth"))


_SOCKETS = """sock AS (SELECT socket_id, ts_s, dst, remote_ip, remote_port, pid, exe FROM (SELECT e.row_id AS socket_id, e.ts_s, e.dst, s.remote_ip, s.remote_port, p.pid, p.exe,
  row_number() OVER (PARTITION BY e.dst, e.ts_s, s.remote_ip, s.remote_port ORDER BY e.row_id) AS n FROM prov_edge e JOIN prov_node s ON s.id = e.src AND s.subtype = 'network socket' JOIN prov_node p ON p.id = e.dst AND p.type = 'Process' WHERE e.operation = 'connect') WHERE n = 1)"""


def sockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.socket_observations(V.prov_edge(spark, sf_dir), V.prov_node(spark, sf_dir), S.usable_ip(F.col("remote_ip"))).select("socket_id", "ts_s", "dst", "remote_ip", "remote_port", "pid", "exe")


@query("j07_socket_observations", f", {_SOCKETS} SELECT * FROM sock")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sockets(spark, sf_dir)


_NEAREST = """near AS (SELECT socket_id, o, arg_min(row_id, (delta, row_id, side)) AS row_id, min(delta) AS delta, arg_min(local_ip, (delta, row_id, side)) AS local_ip FROM (
  SELECT s.socket_id, o, f.row_id, abs(f.ts_s - (s.ts_s + o)) AS delta, 0 AS side, f.dst_ip AS local_ip FROM sock s, (SELECT unnest([-1800, 0, 1800]) AS o), flow f WHERE f.src_ip = s.remote_ip AND f.src_port = s.remote_port AND abs(f.ts_s - (s.ts_s + o)) <= 300
  UNION ALL SELECT s.socket_id, o, f.row_id, abs(f.ts_s - (s.ts_s + o)), 1, f.src_ip FROM sock s, (SELECT unnest([-1800, 0, 1800]) AS o), flow f WHERE f.dst_ip = s.remote_ip AND f.dst_port = s.remote_port AND abs(f.ts_s - (s.ts_s + o)) <= 300) GROUP BY ALL)"""


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.nearest_flow(sockets(spark, sf_dir), V.flow(spark, sf_dir), (-1800, 0, 1800), 300)


@query("j08_nearest_flow", f", {_SOCKETS}, {_NEAREST} SELECT socket_id, o AS offset_s, row_id, round(delta, 6) AS delta, local_ip FROM near")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir).select("socket_id", F.col("offset").alias("offset_s"), "row_id", F.round("delta", 6).alias("delta"), "local_ip")


@query(
    "j09_endpoint_support",
    f""", {_SOCKETS}, {_NEAREST}, m AS (SELECT n.local_ip, s.ts_s, s.exe FROM near n JOIN sock s USING (socket_id) WHERE o = 0)
SELECT local_ip, count(*) AS matches_n, min(ts_s) AS first_s, max(ts_s) AS last_s, count(DISTINCT exe) AS programs, (count(*) >= 10)::INT AS supported, row_number() OVER (ORDER BY count(*) DESC, local_ip) AS place FROM m GROUP BY 1""",
)
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nearest(spark, sf_dir).where("offset = 0").join(sockets(spark, sf_dir), "socket_id")
    per = m.groupBy("local_ip").agg(F.count("*").alias("matches_n"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.countDistinct("exe").alias("programs"))
    from pyspark.sql import Window

    return per.withColumns({"supported": (F.col("matches_n") >= 10).cast("int"), "place": F.row_number().over(Window.orderBy(F.desc("matches_n"), "local_ip"))})


@query("j10_match_counts", f", {_SOCKETS}, {_NEAREST} SELECT o AS offset_s, tol, local_ip, count(*) AS n FROM near, (SELECT unnest({list(V.TOLERANCES)}) AS tol) WHERE delta <= tol GROUP BY ALL")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nearest(spark, sf_dir).withColumn("tol", F.explode(F.array(*map(F.lit, V.TOLERANCES)))).where("delta <= tol")
    return m.groupBy(F.col("offset").alias("offset_s"), "tol", "local_ip").agg(F.count("*").alias("n"))


@query(
    "j11_linked_cases",
    """SELECT c.case_id, count(f.row_id) AS rows_n, (c.network_n > 0 AND c.provenance_n > 0 AND count(f.row_id) > 0)::INT AS linked FROM cases c
LEFT JOIN flow f ON f.label = 1 AND f.tactic = c.tactic AND f.ts_s BETWEEN c.network_start AND c.network_end AND f.src_ip IN ('10.0.0.1', '10.0.0.2') GROUP BY c.case_id, c.network_n, c.provenance_n""",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    cut = W.touched_windows(c.where("network_start is not null"), V.WINDOW, "network_start", "network_end").select("case_id", "tactic", "network_start", "network_end", "window_start")
    attack = V.flow(spark, sf_dir).where("label = 1 and src_ip in ('10.0.0.1', '10.0.0.2')").select("tactic", "ts_s", W.bucket(F.col("ts_s"), V.WINDOW).alias("window_start"))
    hit = cut.join(attack, ["tactic", "window_start"]).where("ts_s between network_start and network_end").groupBy("case_id").agg(F.count("*").alias("touching"))
    out = c.withColumnRenamed("rows_n", "all_rows").join(hit.withColumnRenamed("touching", "rows_n"), "case_id", "left").na.fill(0, ["rows_n"])
    return out.select("case_id", "rows_n", ((F.col("network_n") > 0) & (F.col("provenance_n") > 0) & (F.col("rows_n") > 0)).cast("int").alias("linked"))


@query(
    "j12_address_rows",
    f"SELECT (floor(ts_s / {V.WINDOW}) * {V.WINDOW})::BIGINT AS window_start, count(*) AS rows_n, count(*) FILTER (WHERE src_ip = '10.0.0.3' OR dst_ip = '10.0.1.2') AS touching FROM flow SEMI JOIN (SELECT DISTINCT (floor(anchor / {V.WINDOW}) * {V.WINDOW})::BIGINT AS w FROM anchored) a ON (floor(ts_s / {V.WINDOW}) * {V.WINDOW})::BIGINT = a.w GROUP BY 1",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = cases(spark, sf_dir).select(W.bucket(F.col("anchor"), V.WINDOW).alias("window_start")).distinct()
    flow = V.flow(spark, sf_dir).withColumn("window_start", W.bucket(F.col("ts_s"), V.WINDOW)).join(anchors, "window_start", "left_semi")
    hit = (F.col("src_ip") == "10.0.0.3") | (F.col("dst_ip") == "10.0.1.2")
    return flow.groupBy("window_start").agg(F.count("*").alias("rows_n"), F.count_if(hit).alias("touching"))


@query(
    "j13_two_hops",
    f""", {_REL}, und AS (SELECT DISTINCT case_id, src AS u, dst AS v FROM rel UNION SELECT DISTINCT case_id, dst, src FROM rel),
s AS (SELECT DISTINCT case_id, u AS id FROM und JOIN prov_node n ON n.id = u WHERE n.subtype = 'network socket' AND n.remote_port < 1024), h1 AS (SELECT DISTINCT s.case_id, v AS id FROM s JOIN und ON und.case_id = s.case_id AND und.u = s.id),
h2 AS (SELECT DISTINCT h1.case_id, v AS id FROM h1 JOIN und ON und.case_id = h1.case_id AND und.u = h1.id), a AS (SELECT *, 0 AS hop FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
SELECT case_id, hop, count(*) AS n FROM (SELECT case_id, id, min(hop) AS hop FROM a GROUP BY ALL) GROUP BY ALL""",
)
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relations(spark, sf_dir).select("case_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    seeds = V.prov_node(spark, sf_dir).where("subtype = 'network socket' and remote_port < 1024").select("id")
    touched = edges.select("case_id", F.col("u").alias("id")).union(edges.select("case_id", "v")).join(seeds, "id", "left_semi")
    return J.two_hops(edges, touched).groupBy("case_id", "hop").agg(F.count("*").alias("n"))


@query(
    "j14_overlap_pairs",
    f""", {_GRAPH}, m AS (SELECT case_id, split_part(case_id, '_0', 1) AS group_id, id FROM ent WHERE kind = 'process'), z AS (SELECT case_id, count(*) AS n FROM m GROUP BY 1)
SELECT a.group_id, a.case_id AS case_a, b.case_id AS case_b, count(*) AS shared, round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 9) AS jaccard FROM m a JOIN m b ON a.group_id = b.group_id AND a.id = b.id AND a.case_id < b.case_id JOIN z za ON za.case_id = a.case_id JOIN z zb ON zb.case_id = b.case_id GROUP BY 1, 2, 3""",
)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = entities(spark, sf_dir).where("kind = 'process'").select("case_id", F.split_part("case_id", F.lit("_0"), F.lit(1)).alias("group_id"), "id")
    out = J.overlap_pairs(m, m.groupBy("case_id").agg(F.count("*").alias("n")))
    return out.select("group_id", "case_a", "case_b", "shared", F.round("jaccard", 9).alias("jaccard"))


@query(
    "j16_alignment_checks",
    "SELECT 'only_left' AS problem, count(*) AS n FROM (SELECT row_id FROM flow EXCEPT SELECT row_id FROM prov_edge) UNION ALL SELECT 'only_right', count(*) FROM (SELECT row_id FROM prov_edge EXCEPT SELECT row_id FROM flow) UNION ALL SELECT 'repeated_left', count(*) FROM (SELECT row_id FROM flow GROUP BY 1 HAVING count(*) > 1)",
)
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.key_differences(V.flow(spark, sf_dir).select("row_id"), V.prov_edge(spark, sf_dir).select("row_id"), "row_id").groupBy("problem").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("only_left",), ("only_right",), ("repeated_left",)], "problem string")
    return names.join(found, "problem", "left").na.fill(0, ["n"])


@query(
    "j17_hashed_donor",
    """, s AS (SELECT case_id, fold, tactic FROM scored WHERE y = 1), n AS (SELECT a.case_id, a.fold, a.tactic, (SELECT count(*) FROM s b WHERE b.fold = a.fold AND b.tactic <> a.tactic) AS n FROM s a),
e AS (SELECT fold, tactic AS t, case_id AS donor_id FROM s), k AS (SELECT DISTINCT fold, tactic FROM s),
o AS (SELECT k.fold, k.tactic, donor_id, row_number() OVER (PARTITION BY k.fold, k.tactic ORDER BY t, donor_id) - 1 AS place FROM k JOIN e ON e.fold = k.fold AND e.t <> k.tactic)
SELECT n.case_id, o.donor_id FROM n LEFT JOIN o ON o.fold = n.fold AND o.tactic = n.tactic AND o.place = ('0x' || substr(sha256('donor|' || n.case_id), 1, 15))::BIGINT % n.n""",
)
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.hashed_donor(V.scored(spark, sf_dir).where("y = 1").select("case_id", "fold", "tactic"), "fold", "case_id", "tactic", "donor")


@query(
    "j18_nearest_donors",
    """, p AS (SELECT a.vec_id, a.label = b.label AS same, b.vec_id AS donor_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 9) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, same, arg_min(donor_id, (distance, donor_id)) AS donor_id, round(min(distance), 6) AS distance FROM p GROUP BY 1, 2""",
)
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("block", F.lit(0))
    return J.nearest_donors(rows, "block", "vec_id", "embedding", "label").withColumn("distance", F.round("distance", 6))


@query("j19_disjoint_centres")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    benign = V.flow(spark, sf_dir).where("label = 0").select("protocol", "ts_s")
    return J.disjoint_centres(benign, "protocol", "ts_s", 12, R, 1, 1_000_000)


@query(
    "j20_injected_graph",
    "SELECT relation, operation, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT relation, operation, src FROM prov_edge WHERE label = 1 UNION ALL SELECT relation, operation, 'd_' || src FROM prov_edge WHERE operation = 'open') GROUP BY ALL",
)
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.prov_edge(spark, sf_dir)
    both = J.inject_graph(e.where("label = 1"), e.where("operation = 'open'"), "d_")
    return both.groupBy("relation", "operation").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


BANDS = {"low": (1, 4), "medium": (5, 8), "high": (9, 10**9)}
DONOR_RADIUS = 900
_BAND = "CASE " + " ".join(f"WHEN processes BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in BANDS.items()) + " END"


@query(
    "j20_merged_graphs",
    f""", {_GRAPH}, hr AS (SELECT *, floor(ts_s / 3600)::BIGINT AS donor_id FROM prov_edge), dr AS (SELECT * FROM hr WHERE abs(ts_s - (donor_id * 3600 + 1800)) <= {DONOR_RADIUS} AND donor_id NOT IN (SELECT donor_id FROM hr WHERE label = 1)),
de AS (SELECT DISTINCT donor_id, e.id, {_KIND} AS kind FROM (SELECT donor_id, src AS id FROM dr UNION SELECT donor_id, dst FROM dr) e JOIN prov_node n ON n.id = e.id),
dc AS (SELECT *, {_BAND} AS band FROM (SELECT donor_id, count(*) FILTER (WHERE kind = 'process') AS processes FROM de GROUP BY 1)), dp AS (SELECT donor_id, band, row_number() OVER (PARTITION BY band ORDER BY donor_id) - 1 AS place, count(*) OVER (PARTITION BY band) AS n FROM dc WHERE band IS NOT NULL),
pa AS (SELECT case_id, dp.band, donor_id FROM anchored JOIN dp ON dp.place = ('0x' || substr(sha256(case_id || '|' || dp.band), 1, 15))::BIGINT % dp.n),
oc AS (SELECT case_id, 'kinds' AS field, kind AS key, count(*) AS n FROM ent GROUP BY ALL UNION ALL SELECT case_id, 'types', relation, count(*) FROM rel GROUP BY ALL UNION ALL SELECT case_id, 'operations', operation, count(*) FROM rel GROUP BY ALL),
nc AS (SELECT donor_id, 'kinds' AS field, kind AS key, count(*) AS n FROM de GROUP BY ALL UNION ALL SELECT donor_id, 'types', relation, count(*) FROM dr GROUP BY ALL UNION ALL SELECT donor_id, 'operations', operation, count(*) FROM dr GROUP BY ALL),
un AS (SELECT case_id, band, field, key, n, 0 AS added FROM oc JOIN pa USING (case_id) UNION ALL SELECT case_id, band, field, key, n, n FROM nc JOIN pa USING (donor_id)),
mg AS (SELECT case_id, band, field, key, sum(n)::BIGINT AS n, sum(added)::BIGINT AS added FROM un GROUP BY ALL)
SELECT case_id, band, sum(CASE WHEN field = 'kinds' THEN n ELSE 0 END)::BIGINT AS entities_n, sum(CASE WHEN field = 'types' THEN n ELSE 0 END)::BIGINT AS relations_n, sum(CASE WHEN field = 'kinds' AND key = 'process' THEN added ELSE 0 END)::BIGINT AS injected,
  coalesce(string_agg(key || '=' || n, ',' ORDER BY key || '=' || n) FILTER (WHERE field = 'kinds'), '') AS kinds, coalesce(string_agg(key || '=' || n, ',' ORDER BY key || '=' || n) FILTER (WHERE field = 'types'), '') AS types, coalesce(string_agg(key || '=' || n, ',' ORDER BY key || '=' || n) FILTER (WHERE field = 'operations'), '') AS operations FROM mg GROUP BY 1, 2""",
)
def j20_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's graph with one benign hour of each band of load merged into it."""
    rel, nodes = relations(spark, sf_dir), V.prov_node(spark, sf_dir)
    hours = V.prov_edge(spark, sf_dir).withColumn("donor_id", F.floor(F.col("ts_s") / 3600))
    benign = hours.groupBy("donor_id").agg(F.max("label").alias("bad")).where("bad = 0").select("donor_id")
    donor_rel = stored(hours.where(F.abs(F.col("ts_s") - (F.col("donor_id") * 3600 + 1800)) <= DONOR_RADIUS).join(benign, "donor_id"))
    kind = nodes.select("id", S.entity_kind(F.col("type"), F.col("subtype")).alias("kind"))
    donor_ent = stored(donor_rel.select("donor_id", F.explode(F.array("src", "dst")).alias("id")).distinct().join(kind, "id"))
    n = F.col("processes")
    band = F.coalesce(*(F.when(n.between(*limits), name) for name, limits in BANDS.items()))
    donors = donor_ent.groupBy("donor_id").agg(F.count_if(F.col("kind") == "process").alias("processes")).withColumn("band", band).where("band is not null")
    pairs = J.banded_donors(cases(spark, sf_dir).select("case_id"), donors)
    return G.merged_graphs(stored(pairs), entities(spark, sf_dir, rel), rel, donor_ent, donor_rel)


LEAST_MARGIN = 0.1


@query(
    "a17_drift_table",
    f""", of AS (SELECT unnest({list(V.OFFSETS)}) AS o), ro AS (SELECT c.case_id, o, e.src, e.dst, e.ts_s - (anchor - o) AS delta FROM anchored c, of, prov_edge e WHERE abs(e.ts_s - (anchor - o)) <= {R}),
eo AS (SELECT o, case_id, id, n.label, count(*) AS incident, min(abs(delta)) AS closest FROM (SELECT *, src AS id FROM ro UNION ALL SELECT *, dst FROM ro) x JOIN prov_node n USING (id) WHERE n.type = 'Process' GROUP BY ALL),
so AS (SELECT *, greatest(0, 1 - closest / {R}) AS proximity, round(ln(1 + incident) + greatest(0, 1 - closest / {R}), 6) AS score FROM eo), ko AS (SELECT *, row_number() OVER (PARTITION BY o, case_id ORDER BY score DESC, id) AS r FROM so), t0 AS (SELECT case_id, id AS support_id FROM ko WHERE o = 0 AND r = 1),
fo AS (SELECT k.o, k.case_id, avg(proximity) FILTER (WHERE r <= 3) > 0 AS temporal, bool_or(coalesce(k.id = t0.support_id, false)) AS kept, max(score) FILTER (WHERE r = 1) - coalesce(max(score) FILTER (WHERE r = 2), 0) AS margin, max(label) FILTER (WHERE r = 1) AS correct FROM ko k LEFT JOIN t0 USING (case_id) WHERE r <= 10 GROUP BY 1, 2),
po AS (SELECT of.o, c.case_id, coalesce(temporal, false) AS temporal, coalesce(kept, false) AS kept, coalesce(margin, 0) >= {LEAST_MARGIN} AS lead, coalesce(correct, 0) = 1 AS correct FROM anchored c CROSS JOIN of LEFT JOIN fo ON fo.o = of.o AND fo.case_id = c.case_id)
SELECT o::INT AS offset_s, count(*) AS n, count(*) FILTER (WHERE temporal) AS temporal_n, count(*) FILTER (WHERE kept) AS kept_n, count(*) FILTER (WHERE kept AND temporal AND lead) AS primary_n, count(*) FILTER (WHERE kept AND temporal AND lead AND correct) AS primary_correct,
  count(*) FILTER (WHERE temporal AND lead) AS gate_n, count(*) FILTER (WHERE temporal AND lead AND correct) AS gate_correct, count(*) FILTER (WHERE lead) AS margin_n, count(*) FILTER (WHERE lead AND correct) AS margin_correct FROM po GROUP BY 1""",
)
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy accepts at each clock offset, with the graphs built anew at every offset."""
    c = cases(spark, sf_dir).select("case_id", "anchor")
    offsets = [float(o) for o in V.OFFSETS]
    found = G.offset_relations(c, V.prov_edge(spark, sf_dir).select("ts_s", "src", "dst"), R, offsets)
    d = G.drift(found, V.prov_node(spark, sf_dir), c, offsets, R, LEAST_MARGIN)
    right = F.col("correct") == 1
    both = [x for p, n in (("primary", "primary"), ("gate", "gate"), ("margin_only", "margin")) for x in (F.count_if(p).alias(f"{n}_n"), F.count_if(F.col(p) & right).alias(f"{n}_correct"))]
    return d.groupBy(F.col("offset_s").cast("int").alias("offset_s")).agg(F.count("*").alias("n"), F.count_if("temporal").alias("temporal_n"), F.count_if("kept").alias("kept_n"), *both)


_ROUND = "case_id, id, kind, in_degree, out_degree, incident, round(closest, 6) AS closest, round(proximity, 6) AS proximity, round(ln(1 + incident), 6) AS degree_score, round(ln(1 + incident) + proximity, 6) AS recency_degree"


@query("g01_entity_features", f", {_GRAPH} SELECT {_ROUND} FROM ent")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    return e.select("case_id", "id", "kind", "in_degree", "out_degree", "incident", *(F.round(c, 6).alias(c) for c in ("closest", "proximity", "degree_score", "recency_degree")))


_VALUES = f"""win AS (SELECT case_id, f.* FROM anchored c JOIN flow f ON floor(f.ts_s / {V.WINDOW}) = floor(c.anchor / {V.WINDOW})),
vals AS (SELECT DISTINCT case_id, unnest(['ip', 'ip', 'port', 'port']) AS dimension, unnest([src_ip, dst_ip, src_port::VARCHAR, dst_port::VARCHAR]) AS value FROM win),
mat AS (SELECT e.*, coalesce(EXISTS (SELECT 1 FROM vals v WHERE v.case_id = e.case_id AND v.dimension = 'ip' AND v.value = n.remote_ip), false)::INT AS address_match,
  coalesce(EXISTS (SELECT 1 FROM vals v WHERE v.case_id = e.case_id AND v.dimension = 'port' AND v.value = n.remote_port::VARCHAR), false)::INT AS port_match FROM ent e JOIN prov_node n USING (id))"""


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in the window of each case's anchor; written once, since alerts read them twice."""
    c = cases(spark, sf_dir).select("case_id", W.bucket(F.col("anchor"), V.WINDOW).alias("window_start"))
    return stored(V.flow(spark, sf_dir).withColumn("window_start", W.bucket(F.col("ts_s"), V.WINDOW)).join(c, "window_start"))


def matched(spark: SparkSession, sf_dir: str, rel: DataFrame | None = None) -> DataFrame:
    pairs = (("ip", "src_ip"), ("ip", "dst_ip"), ("port", "src_port"), ("port", "dst_port"))
    values = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in pairs)))
    return G.matches(entities(spark, sf_dir, rel), V.prov_node(spark, sf_dir), alert_rows(spark, sf_dir).select("case_id", values.alias("v")).select("case_id", "v.*"))


@query("g02_alert_matches", f", {_GRAPH}, {_VALUES} SELECT case_id, id, address_match, port_match FROM mat")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("case_id", "id", "address_match", "port_match")


@query(
    "g03_count_maps",
    f""", {_GRAPH}, k AS (SELECT case_id, kind AS x, count(*) AS n FROM ent GROUP BY ALL), o AS (SELECT case_id, operation AS x, count(*) AS n FROM rel GROUP BY ALL)
SELECT case_id, kinds, operations FROM (SELECT case_id, string_agg(x || '=' || n, ',' ORDER BY x || '=' || n) AS kinds FROM k GROUP BY 1) JOIN (SELECT case_id, string_agg(x || '=' || n, ',' ORDER BY x || '=' || n) AS operations FROM o GROUP BY 1) USING (case_id)""",
)
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.groupBy("case_id", column).agg(F.count("*").alias("n")).groupBy("case_id").agg(W.text_map(F.col(column), F.col("n")).alias(out))

    rel = relations(spark, sf_dir)
    return counted(entities(spark, sf_dir, rel), "kind", "kinds").join(counted(rel, "operation", "operations"), "case_id")


_TRUTH = """SELECT case_id, count(*) FILTER (WHERE label = 1) AS bad_entities, count(*) FILTER (WHERE label = 1 AND kind = 'process') AS bad_processes, count(*) FILTER (WHERE kind = 'process') AS processes FROM ent GROUP BY 1"""


@query("g04_case_truth", f", {_GRAPH}, t AS ({_TRUTH}), r AS (SELECT case_id, sum(label)::BIGINT AS bad_relations, string_agg(DISTINCT tactic, ',' ORDER BY tactic) FILTER (WHERE label = 1) AS tactics FROM rel GROUP BY 1) SELECT t.*, r.bad_relations, coalesce(r.tactics, '') AS tactics FROM t JOIN r USING (case_id)")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    process = F.col("kind") == "process"
    t = entities(spark, sf_dir).groupBy("case_id").agg(F.count_if(F.col("label") == 1).alias("bad_entities"), F.count_if((F.col("label") == 1) & process).alias("bad_processes"), F.count_if(process).alias("processes"))
    tactics = F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("tactic")))), ",")
    r = relations(spark, sf_dir).groupBy("case_id").agg(F.sum("label").alias("bad_relations"), tactics.alias("tactics"))
    return t.join(r, "case_id")


@query(
    "g05_case_audit",
    f""", {_GRAPH}, t AS ({_TRUTH}) SELECT count(*) AS cases_n, count(*) FILTER (WHERE t.case_id IS NULL) AS empty_graphs, count(*) FILTER (WHERE bad_processes > 0) AS with_truth, sum(coalesce(processes, 0))::BIGINT AS candidates, count(*) FILTER (WHERE provenance_n = 0) AS network_only FROM cases c LEFT JOIN t USING (case_id)""",
)
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = g04(spark, sf_dir).select("case_id", "bad_processes", "processes", F.lit(1).alias("found"))
    return cases(spark, sf_dir).join(t, "case_id", "left").agg(
        F.count("*").alias("cases_n"), F.count_if(F.col("found").isNull()).alias("empty_graphs"), F.count_if(F.col("bad_processes") > 0).alias("with_truth"),
        F.sum(F.coalesce("processes", F.lit(0))).alias("candidates"), F.count_if(F.col("provenance_n") == 0).alias("network_only"),
    )


_CTX = f"""ctx AS (SELECT e.case_id, e.id, count(*) FILTER (WHERE m.kind = 'file') AS near_file, count(*) FILTER (WHERE m.kind = 'socket') AS near_socket, count(*) FILTER (WHERE e.relation = 'Used') AS used,
  count(*) FILTER (WHERE m.kind = 'socket' AND m.address_match = 1 AND m.port_match = 1) AS socket_both, count(*) FILTER (WHERE m.kind = 'file' AND n.path LIKE '/tmp/%') AS file_tmp,
  min(abs(delta)) AS min_delta, count(*) FILTER (WHERE delta < 0) AS before_n, count(*) FILTER (WHERE operation = 'connect') AS connects, count(*) FILTER (WHERE operation LIKE 'rename%') AS renames, coalesce(max(m.proximity) FILTER (WHERE m.kind = 'socket'), 0) AS socket_proximity
  FROM ends e JOIN ent p ON p.case_id = e.case_id AND p.id = e.id AND p.kind = 'process' JOIN mat m ON m.case_id = e.case_id AND m.id = e.other JOIN prov_node n ON n.id = e.other GROUP BY 1, 2)"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = relations(spark, sf_dir)
    return G.process_context(rel, matched(spark, sf_dir, rel), V.prov_node(spark, sf_dir))


@query("g06_process_context", f", {_GRAPH}, {_VALUES}, {_CTX} SELECT case_id, id, near_file, near_socket, used, socket_both, file_tmp, round(min_delta, 6) AS min_delta, before_n, connects, renames, round(socket_proximity, 6) AS socket_proximity FROM ctx")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir).select(
        "case_id", "id", "near_file", "near_socket", F.col("relation_Used").alias("used"), "socket_both", "file_tmp", F.round("min_delta", 6).alias("min_delta"), "before_n", F.col("operation_connect").alias("connects"), F.col("operation_rename").alias("renames"), F.round("socket_proximity", 6).alias("socket_proximity")
    )


@query(
    "j13_seed_modes",
    f""", {_GRAPH}, {_VALUES}, und AS (SELECT DISTINCT case_id, src AS u, dst AS v FROM rel UNION SELECT DISTINCT case_id, dst, src FROM rel),
sd AS (SELECT case_id, id, rule FROM mat, (SELECT unnest(['joint', 'address', 'port', 'either']) AS rule) WHERE kind = 'socket' AND CASE rule WHEN 'joint' THEN address_match + port_match = 2 WHEN 'address' THEN address_match = 1 WHEN 'port' THEN port_match = 1 ELSE address_match + port_match > 0 END),
h1 AS (SELECT * FROM sd UNION SELECT sd.case_id, und.v, sd.rule FROM sd JOIN und ON und.case_id = sd.case_id AND und.u = sd.id), h2 AS (SELECT * FROM h1 UNION SELECT h1.case_id, und.v, h1.rule FROM h1 JOIN und ON und.case_id = h1.case_id AND und.u = h1.id),
nd AS (SELECT e.case_id, e.id, n.pid, (n.pid <> '' AND EXISTS (SELECT 1 FROM ent t JOIN prov_node m ON m.id = t.id WHERE t.case_id = e.case_id AND t.kind = 'process' AND t.label = 1 AND m.pid = n.pid))::INT AS true_pid FROM ent e JOIN prov_node n ON n.id = e.id),
rr AS (SELECT nd.case_id, r.rule, count(sd.id) AS seeds, count(*) AS nodes, count(h2.id) AS near, max(true_pid) AS truth, coalesce(max(true_pid) FILTER (WHERE h2.id IS NOT NULL), 0) AS near_truth FROM nd CROSS JOIN (SELECT unnest(['joint', 'address', 'port', 'either']) AS rule) r
  LEFT JOIN sd ON sd.case_id = nd.case_id AND sd.id = nd.id AND sd.rule = r.rule LEFT JOIN h2 ON h2.case_id = nd.case_id AND h2.id = nd.id AND h2.rule = r.rule GROUP BY 1, 2)
SELECT case_id, rule, seeds, nodes, CASE WHEN seeds = 0 THEN nodes ELSE near END AS retained, truth, CASE WHEN seeds = 0 THEN truth ELSE near_truth END AS kept FROM rr""",
)
def j13_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four seed rules in one expansion, with the truth that each keeps."""
    rel = relations(spark, sf_dir)
    found = matched(spark, sf_dir, rel).join(V.prov_node(spark, sf_dir).select("id", "pid"), "id")
    return J.seed_pruning(stored(found), rel.select("case_id", F.col("src").alias("u"), F.col("dst").alias("v")))


_ALERTS = """al AS (SELECT case_id, count(*) AS alert_rows, sum(size) AS total_bytes, count(*) FILTER (WHERE protocol = 'TCP') / count(*) AS alert_tcp, count(*) FILTER (WHERE protocol = 'UDP') / count(*) AS alert_udp,
  count(*) FILTER (WHERE protocol = 'ICMP') / count(*) AS alert_icmp, count(*) FILTER (WHERE protocol = 'ARP') / count(*) AS alert_arp FROM win GROUP BY 1),
hh AS (SELECT case_id, dimension, count(*) AS u, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM (SELECT case_id, dimension, value, count(*) AS n FROM (SELECT case_id, unnest(['src_ip', 'dst_ip', 'src_port', 'dst_port']) AS dimension, unnest([src_ip, dst_ip, src_port::VARCHAR, dst_port::VARCHAR]) AS value FROM win) GROUP BY ALL) GROUP BY 1, 2)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert features of each case: rows, concentration of four dimensions, protocol shares."""
    rows = alert_rows(spark, sf_dir)
    share = [(F.count_if(F.col("protocol") == p) / F.count("*")).alias(f"alert_{p.lower()}") for p in ("TCP", "UDP", "ICMP", "ARP")]
    base = rows.groupBy("case_id").agg(F.count("*").alias("alert_rows"), *share)
    spread = W.value_spread(rows, [F.col("case_id")], ["src_ip", "dst_ip", "src_port", "dst_port"])
    wide = spread.groupBy("case_id").agg(*(F.max(F.when(F.col("dimension") == d, F.col("hhi"))).alias(f"alert_hhi_{d}") for d in ("src_ip", "dst_ip", "src_port", "dst_port")))
    return base.join(wide, "case_id")


def process_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entities of all cases with their matches, and the feature vectors of the processes among them."""
    rel, nodes = relations(spark, sf_dir), V.prov_node(spark, sf_dir)
    found = stored(matched(spark, sf_dir, rel))
    return found, G.process_vector(found, G.process_context(rel, found, nodes), nodes, alerts(spark, sf_dir))


@query(
    "g07_process_vector",
    f""", {_GRAPH}, {_VALUES}, {_CTX}, {_ALERTS} SELECT e.case_id, e.id, round(ln(1 + closest), 6) AS log_closest, round(in_degree / incident, 6) AS in_fraction, round(ln(1 + coalesce(near_file, 0)), 6) AS log_near_file, round(ln(1 + coalesce(connects, 0)), 6) AS log_operation_connect,
  (exe IN ('/bin/bash'))::INT::DOUBLE AS utility_shell, round(ln(1 + length(n.name)), 6) AS name_length_log, (n.parent_pid <> '')::INT::DOUBLE AS has_parent, (exe LIKE '/usr/%' OR exe LIKE '/bin/%')::INT::DOUBLE AS f_system_binary, round(coalesce(before_n, 0) / greatest(coalesce(before_n, 0) + (SELECT count(*) FROM ends x JOIN mat y ON y.case_id = x.case_id AND y.id = x.other WHERE x.case_id = e.case_id AND x.id = e.id AND x.delta >= 0), 1), 6) AS before_fraction,
  round(ln(1 + al.alert_rows), 6) AS alert_rows_log, round(hs.hhi, 6) AS alert_hhi_dst_port, round(al.alert_tcp, 6) AS alert_tcp FROM ent e JOIN prov_node n USING (id) LEFT JOIN ctx ON ctx.case_id = e.case_id AND ctx.id = e.id JOIN al ON al.case_id = e.case_id JOIN hh hs ON hs.case_id = e.case_id AND hs.dimension = 'dst_port' WHERE e.kind = 'process'""",
)
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = process_vectors(spark, sf_dir)[1]
    cols = ["log_closest", "in_fraction", "log_near_file", "log_operation_connect", "utility_shell", "name_length_log", "has_parent", "f_system_binary", "before_fraction", "alert_rows_log", "alert_hhi_dst_port", "alert_tcp"]
    return v.select("case_id", "id", *(F.round(c, 6).alias(c) for c in cols))


@query(
    "g08_alert_features",
    f""", {_REL}, {_ENDS}, {_ENT}, {_VALUES}, {_ALERTS} SELECT case_id, round(ln(1 + alert_rows), 6) AS rows_log, round(ln(1 + total_bytes), 6) AS bytes_log, round((anchor - floor(anchor / {V.WINDOW}) * {V.WINDOW}) / {V.WINDOW}, 6) AS trigger_offset, round(ln(1 + u), 6) AS src_ips_log, round(hhi, 6) AS src_ip_hhi, round(alert_udp, 6) AS udp
FROM al JOIN anchored USING (case_id) JOIN hh USING (case_id) WHERE dimension = 'src_ip'""",
)
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alert_rows(spark, sf_dir)
    base = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("size").alias("b"), (F.count_if(F.col("protocol") == "UDP") / F.count("*")).alias("u"))
    spread = W.value_spread(rows, [F.col("case_id")], ["src_ip"])
    c = cases(spark, sf_dir).select("case_id", ((F.col("anchor") - W.bucket(F.col("anchor"), V.WINDOW)) / V.WINDOW).alias("o"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return base.join(spread, "case_id").join(c, "case_id").select("case_id", r(F.log1p("n"), "rows_log"), r(F.log1p("b"), "bytes_log"), r(F.col("o"), "trigger_offset"), r(F.log1p("distinct_values"), "src_ips_log"), r(F.col("hhi"), "src_ip_hhi"), r(F.col("u"), "udp"))


_SC = f"sc AS (SELECT case_id, id, round(ln(1 + incident) + proximity, 6) AS score, in_degree, proximity FROM ent WHERE kind = 'process'), rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS r, score / sum(score) OVER (PARTITION BY case_id) AS p FROM sc)"


@query(
    "g09_ranked_summary",
    f""", {_GRAPH}, {_SC} SELECT case_id, round(sum(score * in_degree) FILTER (WHERE r <= 3) / sum(score) FILTER (WHERE r <= 3), 6) AS top_in_degree, round(max(score) FILTER (WHERE r = 1) - coalesce(max(score) FILTER (WHERE r = 2), 0), 6) AS margin,
  round(-sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))), 6) + 0.0 AS entropy, round(sum(p) FILTER (WHERE r <= 3), 6) AS top_mass, count(*) AS candidates FROM rk GROUP BY 1""",
)
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where("kind = 'process'").select("case_id", "id", F.round("recency_degree", 6).alias("score"), "in_degree")
    out = G.ranked_summary(e, ["in_degree"])
    # Adding zero makes a rounded -0.0 a plain zero.
    return out.select("case_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("top_in_degree", "margin", "entropy", "top_mass")), "candidates")


@query(
    "g10_rank_stability",
    f""", {_GRAPH}, {_SC}, r2 AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY round(score - proximity, 6) DESC, id) AS r FROM sc),
t AS (SELECT a.case_id, list(a.id) FILTER (WHERE a.r <= 3) AS x, list(a.id) FILTER (WHERE b.r <= 3) AS y FROM rk a JOIN r2 b ON a.case_id = b.case_id AND a.id = b.id GROUP BY 1)
SELECT case_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM t""",
)
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where("kind = 'process'").select("case_id", "id", F.round("recency_degree", 6).alias("score"), "proximity")
    out = G.rank_stability(e, e.withColumn("score", F.round(F.col("score") - F.col("proximity"), 6)))
    return out.withColumn("jaccard", F.round("jaccard", 9))


@query(
    "g11_process_document",
    f""", {_GRAPH}, {_SC} SELECT case_id, trim(regexp_replace(string_agg(regexp_replace(lower(exe), '\\b[0-9]+\\b', ' <num> ', 'g'), ' ' ORDER BY r), '\\s+', ' ', 'g')) AS document FROM rk JOIN prov_node USING (id) WHERE r <= 10 GROUP BY 1""",
)
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where("kind = 'process'").select("case_id", "id", F.round("recency_degree", 6).alias("score"))
    top = J.top_k(e, ["case_id"], [F.desc("score"), F.asc("id")], 10, "r").join(V.prov_node(spark, sf_dir).select("id", "exe"), "id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "exe"))), lambda x: x["exe"])
    return top.groupBy("case_id").agg(S.normal_text(F.array_join(ordered, " ")).alias("document"))


@query(
    "g12_packages",
    f""", {_GRAPH}, {_SC}, n AS (SELECT e.case_id, e.id, row_number() OVER (PARTITION BY e.case_id, e.id ORDER BY abs(delta), row_id) AS k, row_id FROM ends e JOIN rk ON rk.case_id = e.case_id AND rk.id = e.id AND rk.r <= 10)
SELECT rk.case_id, r AS rank, rk.id AS entity_id, score, coalesce(string_agg('a_' || substr(sha256(rk.case_id || '|' || rk.id || '|' || row_id), 1, 20), ',' ORDER BY k), '') AS anchors FROM rk LEFT JOIN n ON n.case_id = rk.case_id AND n.id = rk.id AND k <= 3 WHERE r <= 10 GROUP BY 1, 2, 3, 4""",
)
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = relations(spark, sf_dir)
    e = entities(spark, sf_dir, rel).withColumn("recency_degree", F.round("recency_degree", 6))
    p = G.packages(e, rel, V.prov_node(spark, sf_dir)).select("case_id", F.explode("candidates").alias("c"))
    return p.select("case_id", "c.rank", "c.entity_id", "c.score", F.array_join(F.transform("c.anchors", lambda a: a["anchor_id"]), ",").alias("anchors"))


@query(
    "g13_sparse_features",
    f""", {_GRAPH}, {_SC} SELECT case_id, feature, round(sum(1 / r), 9) AS value FROM (SELECT case_id, r, unnest(list_filter(string_split(exe, '/'), lambda x: x <> '')) AS feature FROM rk JOIN prov_node USING (id) WHERE r <= 10) GROUP BY ALL""",
)
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where("kind = 'process'").select("case_id", "id", F.round("recency_degree", 6).alias("score"))
    top = J.top_k(e, ["case_id"], [F.desc("score"), F.asc("id")], 10).join(V.prov_node(spark, sf_dir).select("id", "exe"), "id")
    return G.sparse_features(top, F.filter(F.split("exe", "/"), lambda x: x != "")).withColumn("value", F.round("value", 9))


@query(
    "r10_localisation",
    f""", {_GRAPH}, lr AS (SELECT case_id, id, label, row_number() OVER (PARTITION BY case_id ORDER BY round(ln(1 + incident) + proximity, 6) DESC, id) AS r, row_number() OVER (PARTITION BY case_id ORDER BY incident DESC, id) AS b FROM ent WHERE kind = 'process'),
lc AS (SELECT case_id, count(*) AS n, min(r) FILTER (WHERE label = 1) AS rank, min(b) FILTER (WHERE label = 1) AS base, (count(*) >= 4)::INT AS eligible, (count(*) >= 4 AND max(label) FILTER (WHERE r = 1) = 1)::INT AS confirmed, 1 - max(label) FILTER (WHERE r = 2) AS preserved FROM lr GROUP BY 1)
SELECT k::INT AS k, count(*) AS cases_n, round(avg(coalesce((rank <= k)::INT, 0)), 9) AS hit, round(avg(coalesce((base <= k)::INT, 0)), 9) AS baseline_hit, round(avg(coalesce((rank <= k)::INT, 0)) - avg(coalesce((base <= k)::INT, 0)), 9) + 0.0 AS difference, round(avg(coalesce(rank, n) / n), 9) AS effort,
  sum(eligible)::BIGINT AS eligible_n, sum(confirmed)::BIGINT AS confirmed_n, round(sum(confirmed) / count(*), 9) AS confirmed_all, round(coalesce(sum(confirmed) / nullif(sum(eligible), 0), 0), 9) AS confirmed_eligible,
  count(*) FILTER (WHERE confirmed = 1 AND preserved IS NOT NULL) AS measured_n, round(coalesce(avg(preserved) FILTER (WHERE confirmed = 1), 0), 9) AS preserved FROM lc, (SELECT unnest([1, 3, 5]) AS k) GROUP BY 1""",
)
def r10_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked processes against how often they act; a case of four or more counts as confirmed where its first is true, and as preserved where its second is not."""
    from spanlight.operators import metrics as M

    e = stored(entities(spark, sf_dir).where("kind = 'process'").select(F.col("case_id").alias("case"), "id", F.round("recency_degree", 6).alias("score"), F.col("incident").alias("frequency"), F.col("label").alias("y")))
    top = J.top_k(e, ["case"], [F.desc("score"), F.asc("id")], 2)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("y")))
    seen = top.groupBy("case").agg(at(1).alias("first"), (1 - at(2)).alias("preserved")).join(e.groupBy("case").agg(F.count("*").alias("n")), "case")
    confirmed = seen.select("case", (F.col("n") >= 4).cast("int").alias("eligible"), ((F.col("n") >= 4) & (F.col("first") == 1)).cast("int").alias("confirmed"), "preserved")
    out = M.localisation(e, confirmed)
    return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("hit", "baseline_hit", "difference", "effort", "confirmed_all", "confirmed_eligible", "preserved")})
