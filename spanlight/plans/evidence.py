"""Queries over what cases show under corruptions and over the models that accept or abstain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions.scalars import NETWORK_TACTICS, PROVENANCE_TACTICS
from spanlight.operators import evidence as E
from spanlight.operators import fits
from spanlight.operators import graph as G
from spanlight.operators import joins as J
from spanlight.operators import metrics as M
from spanlight.operators import windows as W
from spanlight.plans import views as V
from spanlight.plans.graph import _ALERTS, _GRAPH, _VALUES, R, alert_rows, relations
from spanlight.plans.registry import query
from spanlight.plans.windows import cases
from spanlight.sources.io import stored

FOLDS = 3
CLASSES = sorted({*NETWORK_TACTICS.values(), *PROVENANCE_TACTICS.values()})
NETWORK = ["rows_log", "bytes_log", "trigger_offset", "src_ips_log", "src_ip_hhi", "tcp", "udp", "icmp"]
VARIANTS = ("clean", *E.FAMILIES, "delete_top", "delete_random")


def folded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with a fold and whether they only calibrate, from hashes of their ids."""
    part = lambda at, n: F.conv(F.substring(F.md5("case_id"), at, 8), 16, 10).cast("bigint") % n
    c = cases(spark, sf_dir).select("case_id", "tactic", "anchor")
    return stored(c.withColumns({"fold": part(1, FOLDS), "calibration": part(9, 4) == 0}))


def case_processes(rel: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The processes of each case with their sockets, and each case's counts of entities and relations."""
    entities = stored(G.entity_features(rel, nodes, R))
    sockets = nodes.where("type <> 'Process' and subtype = 'network socket'").select(F.col("id").alias("other"))
    touching = G.ends(rel).join(sockets, "other", "left_semi").groupBy("case_id", "id").agg(F.count("*").alias("sockets"))
    processes = entities.where("kind = 'process'").join(touching, ["case_id", "id"], "left").na.fill(0, ["sockets"])
    n = lambda k: F.count_if(F.col("kind") == k)
    counts = entities.groupBy("case_id").agg(F.count("*").alias("total"), n("process").alias("processes"), n("file").alias("files"), n("socket").alias("sockets"))
    counts = counts.join(rel.groupBy("case_id").agg(F.count("*").alias("relations")), "case_id")
    return processes.select("case_id", "id", "incident", "sockets", "closest", F.round("proximity", 6).alias("proximity")), counts


def network_features(spark: SparkSession, sf_dir: str, c: DataFrame) -> DataFrame:
    """``c`` with the features of its alert window, 0 where no flow lies in it."""
    rows = alert_rows(spark, sf_dir)
    share = lambda p: (F.count_if(F.col("protocol") == p) / F.count("*")).alias(p.lower())
    flows = rows.groupBy("case_id").agg(F.log1p(F.count("*")).alias("rows_log"), F.log1p(F.sum("size")).alias("bytes_log"), share("TCP"), share("UDP"), share("ICMP"))
    spread = W.value_spread(rows, [F.col("case_id")], ["src_ip"]).select("case_id", F.log1p("distinct_values").alias("src_ips_log"), F.col("hhi").alias("src_ip_hhi"))
    out = c.join(flows, "case_id", "left").join(spread, "case_id", "left").withColumn("trigger_offset", (F.col("anchor") - W.bucket(F.col("anchor"), V.WINDOW)) / V.WINDOW)
    return out.na.fill(0.0, NETWORK)


def represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases under all variants with the features of both views."""
    c = folded_cases(spark, sf_dir)
    processes, counts = case_processes(relations(spark, sf_dir), V.prov_node(spark, sf_dir))
    donors = stored(J.hashed_donor(c, "fold", "case_id", "tactic", "context"))
    summary = E.summaries(E.variants(stored(processes), donors), R)
    return stored(E.representations(network_features(spark, sf_dir, c), summary, counts, donors, VARIANTS))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases under all variants with out-of-fold posteriors of three views and the controller's features."""
    rows = represented(spark, sf_dir)
    models = fits.fit_logistic(fits.balanced(E.class_rows(rows, NETWORK, CLASSES, FOLDS)))
    both = rows.join(E.posteriors(rows, models, NETWORK, CLASSES), ["case_id", "variant"])
    return stored(E.controller_features(both, CLASSES))


def accepted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Judged cases scored by the accept-or-abstain models of their own fold, and calibrating clean cases by those of the other folds."""
    rows = judged(spark, sf_dir)
    models = stored(fits.fit_logistic(fits.balanced(E.accept_rows(rows, FOLDS))))
    test = E.accept_scores(rows.where(F.col("variant").isin("clean", *E.FAMILIES)), models, F.col("fold"))
    reference = rows.where("variant = 'clean' and calibration").withColumn("_f", F.explode(F.array(*map(F.lit, range(FOLDS))))).where("_f <> fold")
    return test, E.accept_scores(reference, models, F.col("_f"))


# The same in SQL. Every fit has one optimum; here it is found by plain Newton steps, each solved by elimination.

_NETWORK_SQL = f"""nw AS (SELECT c.case_id, coalesce(ln(1 + al.alert_rows), 0) AS rows_log, coalesce(ln(1 + al.total_bytes), 0) AS bytes_log, (anchor - floor(anchor / {V.WINDOW}) * {V.WINDOW}) / {V.WINDOW} AS trigger_offset,
  coalesce(ln(1 + u), 0) AS src_ips_log, coalesce(hhi, 0) AS src_ip_hhi, coalesce(alert_tcp, 0) AS tcp, coalesce(alert_udp, 0) AS udp, coalesce(alert_icmp, 0) AS icmp
  FROM anchored c LEFT JOIN al USING (case_id) LEFT JOIN (SELECT * FROM hh WHERE dimension = 'src_ip') s USING (case_id))"""
_SCORE = "round(ln(1 + incident) + proximity + ln(1 + sockets), 6)"
_HASH8 = "('0x' || substr(md5(case_id), {}, 8))::BIGINT"
_CASES_SQL = f"""fc AS MATERIALIZED (SELECT case_id, tactic, anchor, {_HASH8.format(1)} % {FOLDS} AS fold, {_HASH8.format(9)} % 4 = 0 AS calibration FROM anchored),
dn0 AS (SELECT a.case_id, a.fold, a.tactic, (SELECT count(*) FROM fc b WHERE b.fold = a.fold AND b.tactic <> a.tactic) AS n FROM fc a),
dno AS (SELECT k.fold, k.tactic, e.case_id AS donor_id, row_number() OVER (PARTITION BY k.fold, k.tactic ORDER BY e.tactic, e.case_id) - 1 AS place FROM (SELECT DISTINCT fold, tactic FROM fc) k JOIN fc e ON e.fold = k.fold AND e.tactic <> k.tactic),
dn AS (SELECT n.case_id, o.donor_id FROM dn0 n JOIN dno o ON o.fold = n.fold AND o.tactic = n.tactic AND o.place = ('0x' || substr(sha256('context|' || n.case_id), 1, 15))::BIGINT % n.n),
pr AS (SELECT e.case_id, e.id, e.incident, e.closest, round(e.proximity, 6) AS proximity, coalesce(s.n, 0) AS sockets FROM ent e LEFT JOIN (SELECT x.case_id, x.id, count(*) AS n FROM ends x JOIN prov_node m ON m.id = x.other
  WHERE m.type <> 'Process' AND m.subtype = 'network socket' GROUP BY 1, 2) s ON s.case_id = e.case_id AND s.id = e.id WHERE e.kind = 'process'),
pk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY case_id) AS n, ('0x' || substr(sha256(case_id || '|' || id), 16, 1))::INT % 2 = 0 AS even FROM (SELECT *, {_SCORE} AS score FROM pr)),
pe AS MATERIALIZED (SELECT *, bool_or(even) OVER (PARTITION BY case_id) AS has_even, row_number() OVER (PARTITION BY case_id, r <= least(3, n // 2) ORDER BY sha256('random-delete|' || case_id || '|' || id)) AS o, least(3, n // 2) AS k FROM pk),
va AS (SELECT case_id, 'clean' AS variant, id, incident, closest, proximity, sockets FROM pe UNION ALL SELECT case_id, 'delete_socket', id, incident, closest, proximity, 0 FROM pe
  UNION ALL SELECT case_id, 'shift_time', id, incident, closest + 600, 0, sockets FROM pe UNION ALL SELECT case_id, 'half_delete', id, incident, closest, proximity, round_even(sockets / 2, 0)::BIGINT FROM pe WHERE even OR (NOT has_even AND r = 1)
  UNION ALL SELECT d.case_id, 'replace_context', id, incident, closest, proximity, sockets FROM dn d JOIN pe p ON p.case_id = d.donor_id
  UNION ALL SELECT case_id, 'delete_top', id, incident, closest, proximity, sockets FROM pe WHERE n >= 4 AND r > k UNION ALL SELECT case_id, 'delete_random', id, incident, closest, proximity, sockets FROM pe WHERE n >= 4 AND (r <= k OR o > k)),
vs AS (SELECT *, {_SCORE} AS score, round(ln(1 + incident) + greatest(0, 1 - (closest + 30) / {R}) + ln(1 + sockets), 6) AS moved FROM va),
vr AS (SELECT *, row_number() OVER (PARTITION BY case_id, variant ORDER BY score DESC, id) AS r, row_number() OVER (PARTITION BY case_id, variant ORDER BY moved DESC, id) AS m, score / sum(score) OVER (PARTITION BY case_id, variant) AS p FROM vs),
su AS (SELECT case_id, variant, count(*) AS n, max(score) FILTER (WHERE r = 1) AS top, max(score) FILTER (WHERE r = 1) - coalesce(max(score) FILTER (WHERE r = 2), 0) AS gap, -sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))) / greatest(ln(count(*)), 1) AS ent,
  sum(p) FILTER (WHERE r <= 3) AS mass, avg(proximity) FILTER (WHERE r <= 3) AS near, avg(ln(1 + sockets)) FILTER (WHERE r <= 3) AS sock, count(*) FILTER (WHERE r <= 3 AND m <= 3) / (2 * least(3, count(*)) - count(*) FILTER (WHERE r <= 3 AND m <= 3)) AS stable FROM vr GROUP BY 1, 2),
ct AS (SELECT case_id, count(*) AS total, count(*) FILTER (WHERE kind = 'process') AS processes, count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind = 'socket') AS sockets, any_value(rn.n) AS relations FROM ent JOIN (SELECT case_id, count(*) AS n FROM rel GROUP BY 1) rn USING (case_id) GROUP BY 1),
re0 AS (SELECT fc.*, v.variant, coalesce(su.n, 0) AS n, coalesce(ct.total, 0) AS total0, coalesce(ct.processes, 0) AS processes, coalesce(ct.files, 0) AS files, coalesce(ct.sockets, 0) AS sockets, coalesce(ct.relations, 0) AS relations,
  [coalesce(top, 0), coalesce(gap, 0), coalesce(ent, 0), coalesce(mass, 0), coalesce(near, 0), coalesce(sock, 0), coalesce(stable, 0)] AS tops
  FROM fc CROSS JOIN (SELECT unnest({list(VARIANTS)}) AS variant) v LEFT JOIN dn ON dn.case_id = fc.case_id LEFT JOIN ct ON ct.case_id = CASE WHEN v.variant = 'replace_context' THEN dn.donor_id ELSE fc.case_id END
  LEFT JOIN su ON su.case_id = fc.case_id AND su.variant = v.variant WHERE (v.variant <> 'replace_context' OR dn.donor_id IS NOT NULL) AND (v.variant NOT LIKE 'delete_%' OR v.variant IN ('delete_process', 'delete_socket') OR su.n > 0)),
re AS (SELECT *, CASE WHEN variant = 'half_delete' THEN greatest(n, round_even(total0 * 0.5::DOUBLE, 0)) ELSE total0 END::DOUBLE AS total FROM re0),
rp AS MATERIALIZED (SELECT re.case_id, tactic, fold, calibration, variant, n, [rows_log, bytes_log, trigger_offset, src_ips_log, src_ip_hhi, tcp, udp, icmp]::DOUBLE[] AS nx,
  list_concat([ln(1 + n), ln(1 + total), ln(1 + CASE WHEN variant = 'half_delete' THEN round_even(relations * 0.5::DOUBLE, 0) ELSE relations END),
    CASE WHEN variant = 'delete_process' THEN 0 WHEN variant IN ('half_delete', 'delete_top', 'delete_random') THEN n ELSE processes END / greatest(total, 1), files / greatest(total, 1), CASE WHEN variant = 'delete_socket' THEN 0 ELSE sockets END / greatest(total, 1)]::DOUBLE[], tops::DOUBLE[]) AS px
  FROM re JOIN nw USING (case_id))"""


def newton_sql(name: str, rows: str, width: int, ridge: float = 1 / 0.3, steps: int = 12) -> str:
    """CTEs that fit ``rows`` (``model, x, y, w``): the last one is ``name`` with ``model, mean, scale, b``, weights balanced by class."""
    d = width + 1
    pivot = f"""list_reduce(list_transform(range({d + 1}), lambda z: a), lambda m, unused, i: list_transform(range(1, {d + 1}), lambda r: CASE WHEN r = i - 1 THEN list_transform(m[i - 1], lambda v: v / m[i - 1][i - 1])
    ELSE list_transform(range(1, {d + 2}), lambda c: m[r][c] - m[r][i - 1] / m[i - 1][i - 1] * m[i - 1][c]) END))"""
    parts = [
        f"{name}_n AS (SELECT model, count(*) AS n, sum(y) AS p FROM {rows} GROUP BY 1)",
        f"{name}_r AS MATERIALIZED (SELECT row_number() OVER () AS id, model, x, y, w * n / (2 * CASE WHEN y = 1 THEN p ELSE n - p END) AS w FROM {rows} JOIN {name}_n USING (model) WHERE p > 0 AND p < n)",
        f"{name}_m AS (SELECT model, i, avg(v) AS mean, CASE WHEN stddev_pop(v) > 1e-6 * greatest(sqrt(avg(v * v)), 1e-150) THEN stddev_pop(v) ELSE 1 END AS scale FROM (SELECT model, unnest(range(1, {width + 1})) AS i, unnest(x) AS v FROM {name}_r) GROUP BY 1, 2)",
        f"{name}_s AS MATERIALIZED (SELECT model, list(mean ORDER BY i) AS mean, list(scale ORDER BY i) AS scale FROM {name}_m GROUP BY 1)",
        f"{name}_x AS MATERIALIZED (SELECT id, r.model, list_append(list_transform(range(1, {width + 1}), lambda i: (x[i] - mean[i]) / scale[i]), 1.0::DOUBLE) AS x, y, w FROM {name}_r r JOIN {name}_s s ON s.model = r.model)",
        f"{name}_e AS MATERIALIZED (SELECT id, model, y, w, i, x[i] AS v FROM {name}_x, (SELECT unnest(range(1, {d + 1})) AS i))",
        f"{name}_b0 AS (SELECT model, list_transform(range({d}), lambda i: 0.0::DOUBLE) AS b FROM {name}_s)",
    ]
    for k in range(steps):
        b, t = f"{name}_b{k}", f"{name}_{k}"
        parts += [
            f"{t}p AS MATERIALIZED (SELECT id, x.model, 1 / (1 + exp(-list_sum(list_transform(list_zip(x, b), lambda z: z[1] * z[2])))) AS p FROM {name}_x x JOIN {b} c ON c.model = x.model)",
            f"""{t}h AS (SELECT a.model, a.i, c.i AS j, sum(a.w * p * (1 - p) * a.v * c.v) + CASE WHEN a.i = c.i THEN {ridge!r} ELSE 0 END AS v FROM {name}_e a JOIN {name}_e c ON c.id = a.id JOIN {t}p q ON q.id = a.id GROUP BY 1, 2, 3
  UNION ALL SELECT a.model, a.i, {d + 1}, sum(a.w * (p - a.y) * a.v) + {ridge!r} * any_value(c.b[a.i]) FROM {name}_e a JOIN {t}p q ON q.id = a.id JOIN {b} c ON c.model = a.model GROUP BY 1, 2)""",
            f"{t}a AS (SELECT model, list(row ORDER BY i) AS a FROM (SELECT model, i, list(v ORDER BY j) AS row FROM {t}h GROUP BY 1, 2) GROUP BY 1)",
            f"{name}_b{k + 1} AS MATERIALIZED (SELECT c.model, list_transform(range(1, {d + 1}), lambda i: b[i] - s[i][{d + 1}]) AS b FROM {b} c JOIN (SELECT model, {pivot} AS s FROM {t}a) t ON t.model = c.model)",
        ]
    parts.append(f"{name} AS MATERIALIZED (SELECT model, mean, scale, b FROM {name}_b{steps} JOIN {name}_s USING (model))")
    return ",\n".join(parts)


def _scored_sql(x: str, width: int) -> str:
    return f"1 / (1 + exp(-list_sum(list_transform(range(1, {width + 1}), lambda i: ({x}[i] - mean[i]) / scale[i] * b[i])) - b[{width + 1}]))"


_WIDE = len(NETWORK) + len(E.SUMMARY)
_ZERO = lambda n: str([0.0] * n) + "::DOUBLE[]"
_VIEWS = f"[{{'view': 'network', 'x': list_concat(nx, {_ZERO(len(E.SUMMARY))})}}, {{'view': 'provenance', 'x': list_concat({_ZERO(len(NETWORK))}, px)}}, {{'view': 'combined', 'x': list_concat(nx, px)}}]"
_JS = "0.5 * list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * ln(2 * z[1] / (z[1] + z[2])) ELSE 0 END)) + 0.5 * list_sum(list_transform(list_zip({b}, {a}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * ln(2 * z[1] / (z[1] + z[2])) ELSE 0 END))"
_CLIP = "list_transform({p}, lambda x: greatest(least(x, 1.0), 1e-12))"
_UNIT = "list_transform({c}, lambda x: x / list_sum({c}))"


def _posterior_sql() -> str:
    wide = ", ".join(f"list(p ORDER BY class) FILTER (WHERE view = '{v}') AS {v}" for v in E.VIEWS)
    clipped = ", ".join(f"{_UNIT.format(c=_CLIP.format(p=v))} AS u_{v}" for v in E.VIEWS)
    m = lambda v: f"list_reverse_sort({v})[1] - list_reverse_sort({v})[2]"
    at = lambda v: f"list_position({v}, list_max({v}))"
    ent = f"-list_sum(list_transform({_CLIP.format(p='combined')}, lambda x: x * ln(x)))"
    js = lambda a, b: _JS.format(a=f"u_{a}", b=f"u_{b}")
    return f"""tr AS (SELECT f.f || '|' || v.view || '|' || k.class AS model, v.x AS x, (tactic = k.class)::INT AS y, 1.0::DOUBLE AS w FROM (SELECT *, unnest({_VIEWS}) AS v FROM rp WHERE variant = 'clean') r, (SELECT unnest({CLASSES}) AS class) k, (SELECT unnest(range({FOLDS})) AS f) f WHERE f.f <> r.fold),
{newton_sql('tm', 'tr', _WIDE)},
po AS (SELECT case_id, variant, v.view AS view, k.class, coalesce({_scored_sql('v.x', _WIDE)}, 0) AS s FROM (SELECT *, unnest({_VIEWS}) AS v FROM rp) r CROSS JOIN (SELECT unnest({CLASSES}) AS class) k LEFT JOIN tm ON tm.model = r.fold || '|' || v.view || '|' || k.class),
pn AS (SELECT case_id, variant, view, class, CASE WHEN sum(s) OVER w > 0 THEN round(s / sum(s) OVER w, 12) ELSE 1.0::DOUBLE / {len(CLASSES)} END AS p FROM po WINDOW w AS (PARTITION BY case_id, variant, view)),
pw AS (SELECT case_id, variant, {wide} FROM pn GROUP BY 1, 2),
pu AS MATERIALIZED (SELECT *, {clipped} FROM pw),
ju AS MATERIALIZED (SELECT rp.*, combined, network, provenance, ({CLASSES}[{at('combined')}] = tactic)::INT AS correct, 3 - len(list_distinct([{', '.join(at(v) for v in E.VIEWS)}])) AS level,
  list_concat([list_max(combined), {m('combined')}, ({ent}) / ln({len(CLASSES)}), list_max(network), {m('network')}, list_max(provenance), {m('provenance')}, {js('network', 'provenance')}, {js('combined', 'network')}, {js('combined', 'provenance')},
    ({at('network')} = {at('provenance')})::INT::DOUBLE, ({at('network')} = {at('provenance')} AND {at('network')} = {at('combined')})::INT::DOUBLE]::DOUBLE[], px) AS x FROM rp JOIN pu USING (case_id, variant))"""


def _mask_sql(names: tuple[str, ...], x: str = "x") -> str:
    places = [i + 1 for i, c in enumerate(E.CONTROLLER) if c in names]
    return f"list_transform(range(1, {len(E.CONTROLLER) + 1}), lambda i: CASE WHEN list_contains({places}, i) THEN {x}[i] ELSE 0 END)"


def _accept_sql() -> str:
    n, width = len(E.FAMILIES), len(E.CONTROLLER)
    families = ", ".join(f"'{f}'" for f in E.FAMILIES)
    right = "(variant = 'clean' AND correct = 1)::INT"
    return f"""le AS (SELECT ju.*, f.f FROM ju, (SELECT unnest(range({FOLDS})) AS f) f WHERE f.f <> fold AND NOT calibration AND variant IN ('clean', {families})),
ar AS (SELECT f || '|controller|' AS model, {_mask_sql(E.CONTROLLER)} AS x, {right} AS y, CASE variant WHEN 'clean' THEN 0.5 ELSE 0.5 / {n} END::DOUBLE AS w FROM le
  UNION ALL SELECT f || '|integrity|', {_mask_sql(E.INTEGRITY)}, (variant = 'clean')::INT, CASE variant WHEN 'clean' THEN 0.5 ELSE 0.5 / {n} END::DOUBLE FROM le
  UNION ALL SELECT f || '|posterior|', {_mask_sql(E.POSTERIOR)}, correct, 1.0::DOUBLE FROM le WHERE variant = 'clean'
  UNION ALL SELECT f || '|controller|' || h.held, {_mask_sql(E.CONTROLLER)}, {right}, CASE variant WHEN 'clean' THEN 0.5 ELSE 0.5 / {n - 1} END::DOUBLE FROM le, (SELECT unnest([{families}]) AS held) h WHERE variant <> h.held),
{newton_sql('am', 'ar', width)},
rf AS (SELECT ju.*, fold AS f, true AS test FROM ju WHERE variant IN ('clean', {families}) UNION ALL SELECT ju.*, f.f, false FROM ju, (SELECT unnest(range({FOLDS})) AS f) f WHERE f.f <> fold AND calibration AND variant = 'clean'),
ac AS MATERIALIZED (SELECT rf.*, (SELECT {_scored_sql('rf.x', width)} FROM am WHERE am.model = rf.f || '|controller|') AS controller, (SELECT {_scored_sql(_mask_sql(E.INTEGRITY, 'rf.x'), width)} FROM am WHERE am.model = rf.f || '|integrity|') AS integrity,
  (SELECT {_scored_sql(_mask_sql(E.POSTERIOR, 'rf.x'), width)} FROM am WHERE am.model = rf.f || '|posterior|') AS posterior_lr, (SELECT {_scored_sql('rf.x', width)} FROM am WHERE am.model = rf.f || '|controller|' || rf.variant) AS held_out FROM rf)"""


_REPRESENTED = f"{_GRAPH}, {_VALUES}, {_ALERTS}, {_NETWORK_SQL}, {_CASES_SQL}"
_JUDGED = f"{_REPRESENTED}, {_posterior_sql()}"


@query(
    "m05_view_posteriors",
    f", {_JUDGED} SELECT case_id, variant, list_position(combined, list_max(combined))::INT AS combined_class, round(list_max(combined), 6) AS combined_confidence, round(list_max(network), 6) AS network_confidence, round(list_max(provenance), 6) AS provenance_confidence, correct FROM ju WHERE variant NOT IN ('delete_top', 'delete_random')",
)
def m05_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).where("variant not in ('delete_top', 'delete_random')")
    top = lambda v: F.round(F.array_max(v), 6).alias(f"{v}_confidence")
    return j.select("case_id", "variant", E.best(F.col("combined")).cast("int").alias("combined_class"), top("combined"), top("network"), top("provenance"), "correct")


@query("m10_accept_models", f", {_JUDGED}, {_accept_sql()} SELECT case_id, variant, fold, correct, round(controller, 6) AS controller, round(integrity, 6) AS integrity, round(posterior_lr, 6) AS posterior_lr, round(held_out, 6) AS held_out FROM ac WHERE test")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller, the integrity and the posterior model, and the controller that never saw the row's family."""
    test, _ = accepted(spark, sf_dir)
    return test.select("case_id", "variant", "fold", "correct", *(F.round(c, 6).alias(c) for c in ("controller", "integrity", "posterior_lr", "held_out")))


@query(
    "a09_selector_scores",
    f""", {_JUDGED}, {_accept_sql()}, pc AS (SELECT t.case_id, t.variant, (count(*) FILTER (WHERE r.x[1] < t.x[1]) + count(*) FILTER (WHERE r.x[1] = t.x[1]) / 2) / count(*) AS c, (count(*) FILTER (WHERE r.integrity < t.integrity) + count(*) FILTER (WHERE r.integrity = t.integrity) / 2) / count(*) AS i
  FROM ac t JOIN ac r ON r.f = t.f AND NOT r.test WHERE t.test AND t.integrity IS NOT NULL GROUP BY 1, 2)
SELECT ac.case_id, ac.variant, round(x[1], 6) AS confidence, round(1 - x[3], 6) AS entropy, round(x[2], 6) AS margin, round(posterior_lr, 6) AS posterior_lr, round(level + 0.5 * x[1], 6) AS cross_view, round(controller, 6) AS controller, round(integrity, 6) AS integrity, round(least(c, i), 6) AS dual
FROM ac LEFT JOIN pc ON pc.case_id = ac.case_id AND pc.variant = ac.variant WHERE test""",
)
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight selector scores; ``dual`` is the lower percentile of confidence and integrity among calibrating clean cases."""
    test, reference = accepted(spark, sf_dir)
    test, reference = stored(test.withColumn("for_fold", F.col("fold"))), stored(reference)
    ranked = test
    for score in ("combined_confidence", "integrity"):
        values = test.where("integrity is not null").select("case_id", "variant", "for_fold", score)
        ranked = ranked.join(M.mid_percentile(values, reference, ["for_fold"], score).select("case_id", "variant", F.col("percentile").alias(f"{score}_percentile")), ["case_id", "variant"], "left")
    r = lambda c, n: F.round(c, 6).alias(n)
    level = E.agreement_level([F.col(v) for v in ("combined", "network", "provenance")])
    dual = F.when(F.col("combined_confidence_percentile").isNotNull() & F.col("integrity_percentile").isNotNull(), F.least("combined_confidence_percentile", "integrity_percentile"))
    return ranked.select(
        "case_id", "variant", r(F.col("combined_confidence"), "confidence"), r(1 - F.col("combined_entropy"), "entropy"), r(F.col("combined_margin"), "margin"), r(F.col("posterior_lr"), "posterior_lr"),
        r(level + 0.5 * F.col("combined_confidence"), "cross_view"), r(F.col("controller"), "controller"), r(F.col("integrity"), "integrity"), r(dual, "dual"),
    )


@query(
    "m12_deletion_lift",
    f""", {_JUDGED}, tp AS (SELECT case_id, variant, combined[list_position({CLASSES}, tactic)] AS p FROM ju)
SELECT c.case_id, round(c.p, 6) AS clean_probability, round(c.p - t.p, 6) + 0.0 AS top_drop, round(c.p - o.p, 6) + 0.0 AS random_drop, round(o.p - t.p, 6) + 0.0 AS lift FROM tp c JOIN tp t ON t.case_id = c.case_id AND t.variant = 'delete_top' JOIN tp o ON o.case_id = c.case_id AND o.variant = 'delete_random' WHERE c.variant = 'clean'""",
)
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more the probability of the true class falls without the best processes than without as many others."""
    own = F.element_at("combined", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("tactic")).cast("int"))
    p = judged(spark, sf_dir).where("variant in ('clean', 'delete_top', 'delete_random')").groupBy("case_id").agg(*(F.max(F.when(F.col("variant") == v, own)).alias(v) for v in ("clean", "delete_top", "delete_random")))
    d = lambda a, b, n: (F.round(F.col(a) - F.col(b), 6) + F.lit(0.0)).alias(n)
    return p.where("delete_top is not null").select("case_id", F.round("clean", 6).alias("clean_probability"), d("clean", "delete_top", "top_drop"), d("clean", "delete_random", "random_drop"), d("delete_random", "delete_top", "lift"))


def _pair_sql() -> tuple[list[str], list[str]]:
    m = lambda v: f"list_reverse_sort({v})[1] - list_reverse_sort({v})[2]"
    ent = lambda v: f"-list_sum(list_transform({_CLIP.format(p=v)}, lambda x: x * ln(x)))"
    zipped = lambda f: f"list_sum(list_transform(list_zip(network, provenance), lambda z: {f}))"
    net = {c: f"nx[{NETWORK.index(c) + 1}]" for c in E.PAIR_NETWORK}
    prov = {c: f"px[{E.SUMMARY.index(c) + 1}]" for c in E.PAIR_PROVENANCE}
    out = {
        "affinity": zipped("sqrt(z[1] * z[2])"), "js_divergence": "x[8]", "posterior_l1": zipped("abs(z[1] - z[2])"), "top_agreement": "x[11]",
        "network_confidence": "list_max(network)", "provenance_confidence": "list_max(provenance)", "network_margin": m("network"), "provenance_margin": m("provenance"), "network_entropy": ent("network"), "provenance_entropy": ent("provenance"),
    }
    for k, c in enumerate(CLASSES, 1):
        out |= {f"network_p_{c}": f"network[{k}]", f"provenance_p_{c}": f"provenance[{k}]", f"posterior_absdiff_{c}": f"abs(network[{k}] - provenance[{k}])", f"posterior_product_{c}": f"network[{k}] * provenance[{k}]"}
    out |= {f"network_s_{c}": v for c, v in net.items()} | {f"provenance_s_{c}": v for c, v in prov.items()}
    out |= {f"cross_{a}_{b}": f"{net[a]} * {prov[b]}" for a in net for b in prov}
    return list(out), list(out.values())


_NAMES, _VALUES_SQL = _pair_sql()
_KEPT = """CASE mode WHEN 'full' THEN true WHEN 'network_only' THEN starts_with(name, 'network_') WHEN 'provenance_only' THEN starts_with(name, 'provenance_')
  ELSE NOT (starts_with(name, 'posterior_') OR starts_with(name, 'network_p_') OR name IN ('affinity', 'js_divergence', 'top_agreement', 'network_confidence', 'network_margin', 'network_entropy')) END"""

#: Products of scores that are rounded themselves often lie half way between two sixth digits.
_PLAIN = "starts_with(name, 'network_s_') OR starts_with(name, 'provenance_s_') OR starts_with(name, 'cross_')"


@query(
    "m08_feature_modes",
    f""", {_JUDGED}, pf AS (SELECT case_id, variant, unnest({_NAMES}) AS name, unnest([{', '.join(_VALUES_SQL)}]::DOUBLE[]) AS value FROM ju WHERE variant IN ('clean', 'replace_context'))
SELECT case_id, variant, mode, name, round(value, CASE WHEN {_PLAIN} THEN 9 ELSE 6 END) + 0.0 AS value FROM pf, (SELECT unnest({list(E.PAIR_MODES)}) AS mode) WHERE {_KEPT}""",
)
def m08_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair features of true and of replaced contexts in all four modes."""
    features = E.pair_features(CLASSES)
    rows = judged(spark, sf_dir).where("variant in ('clean', 'replace_context')")
    kept = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(c).alias("name"), (F.round(features[c].cast("double"), 9 if c.startswith(("network_s_", "provenance_s_", "cross_")) else 6) + F.lit(0.0)).alias("value")) for m in E.PAIR_MODES for c in E.mode_features(features, m)))
    return rows.select("case_id", "variant", F.explode(kept).alias("_k")).select("case_id", "variant", "_k.*")


@query("m11_view_binding")
def m11_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a context belongs to its alert: out-of-fold scores of true and of replaced contexts in all four modes, twelve fits as rows."""
    pairs, train = E.binding_rows(judged(spark, sf_dir), CLASSES, FOLDS)
    scored = fits.score_rows(pairs, fits.fit_logistic(fits.balanced(train)))
    return scored.select("case_id", "variant", "mode", "fold", "y", F.round("score", 6).alias("score"))


@query(
    "a10_view_calibration",
    f""", {_JUDGED}, cb AS (SELECT fold, correct, list_max(combined) AS c, list_sum(list_transform(range(1, {len(CLASSES) + 1}), lambda i: (combined[i] - CASE WHEN {CLASSES}[i] = tactic THEN 1 ELSE 0 END) ** 2)) AS b FROM ju WHERE variant = 'clean'),
ec AS (SELECT fold, sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT fold, least(floor(c * 5), 4) AS bin, count(*) AS n, avg(c) AS c, avg(correct) AS a FROM cb GROUP BY 1, 2) GROUP BY 1)
SELECT fold, count(*) AS n, round(avg(b), 6) AS brier, round(avg(correct), 6) AS accuracy, round(any_value(ece), 6) AS ece FROM cb JOIN ec USING (fold) GROUP BY 1""",
)
def a10_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiclass Brier score, accuracy and calibration error of the combined posteriors of clean cases."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("tactic"))
    rows = judged(spark, sf_dir).where("variant = 'clean'").select("fold", "correct", F.array_max("combined").alias("score"), E.brier_score(F.col("combined"), place).alias("brier"))
    rows = stored(rows)
    out = rows.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("brier"), 6).alias("brier"), F.round(F.avg("correct"), 6).alias("accuracy"))
    return out.join(M.calibration_error(rows, ["fold"]).select("fold", F.round("ece", 6).alias("ece")), "fold")
