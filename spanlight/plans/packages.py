"""Queries over packages and certificates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import graph as G
from spanlight.operators import joins as J
from spanlight.operators import packages as L
from spanlight.plans import views as V
from spanlight.plans.graph import _GRAPH, _SC, entities, relations
from spanlight.plans.registry import query
from spanlight.sources.io import stored

_TOP = f"""{_GRAPH}, {_SC}, top AS (SELECT case_id, r AS rank, id AS entity_id FROM rk WHERE r <= 10)"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = relations(spark, sf_dir)
    e = entities(spark, sf_dir, rel).withColumn("recency_degree", F.round("recency_degree", 6))
    p = stored(G.packages(e, rel, V.prov_node(spark, sf_dir)))
    return p.withColumn("proposal", F.element_at(F.array(*map(F.lit, L.TACTICS)), (F.length("case_id") % 5 + 1).cast("int")))


def responses(p: DataFrame) -> DataFrame:
    """Certificates with planted faults: the variant is the last digit of the case number modulo 5."""
    first = lambda path: F.element_at(F.col("candidates"), 1)[path]
    p = p.withColumn("variant", (F.substring("case_id", -1, 1).cast("int") % 5).cast("int"))
    anchor = F.element_at(first("anchors"), 1)["anchor_id"]
    v = F.col("variant")
    body = F.struct(
        F.lit("3.0").alias("schema_version"), F.when(v == 1, F.lit("other")).otherwise(F.col("case_id")).alias("case_id"), F.col("proposal").alias("tactic"), (v != 2).alias("evidence_sufficient"), F.lit(False).alias("integrity_alarm"),
        F.when(v == 3, F.lit(1.5)).otherwise(F.lit(0.5)).alias("confidence"), F.when(v == 4, F.lit("P99")).otherwise(F.lit("P1")).alias("support_process_ref"), F.array(anchor).alias("cited_anchor_ids"), F.array(F.lit("sufficient_observed_support")).alias("reason_codes"),
    )
    return p.select("case_id", "variant", F.to_json(body).alias("response"))


@query("l01_first_json")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" {x "), F.to_json(F.struct("conv_id", "role")), F.when(F.col("conv_id") % 2 == 0, F.lit(" tail")).otherwise(F.lit("")))
    return c.select("conv_id", "turn", L.first_json(text).alias("j")).select("conv_id", "turn", "j.json", "j.trailing")


_VARIANT = {0: "", 1: "case_id_mismatch", 2: "attribute_without_sufficiency", 3: "invalid_confidence_range", 4: "anchor_owner_not_cited,attribute_without_observed_anchor,hallucinated_entity_id,hallucinated_process_ref"}
_CHECKED = f"""{_TOP}, ck AS (SELECT case_id, variant, CASE variant {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _VARIANT.items())} END AS errors FROM (SELECT DISTINCT case_id, (right(case_id, 1)::INT % 5)::INT AS variant FROM top))"""


@query("l02_certificates", f", {_CHECKED} SELECT case_id, variant, CASE WHEN errors = '' THEN 'attribute' ELSE 'abstain' END AS decision, errors = '' AS valid, errors FROM ck")
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packages(spark, sf_dir)
    out = L.check_certificates(responses(p), p)
    return out.select("case_id", "variant", "decision", "valid", F.array_join("errors", ",").alias("errors"))


@query(
    "l03_failure_taxonomy",
    f", {_CHECKED} SELECT variant, count(*) AS n, count(*) FILTER (WHERE errors <> '') AS failed, count(*) FILTER (WHERE errors LIKE '%attribute_without%') AS evidence_obligation, count(*) FILTER (WHERE errors LIKE '%hallucinated%') AS reference_ownership, count(*) FILTER (WHERE errors LIKE '%mismatch%') AS decision_or_schema FROM ck GROUP BY 1",
)
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packages(spark, sf_dir)
    out = L.failure_taxonomy(L.check_certificates(responses(p), p), ["variant"])
    return out.select("variant", "n", "failed", "evidence_obligation", "reference_ownership", "decision_or_schema")


@query(
    "l04_issuance_rates",
    "SELECT model, condition, count(*) AS n, sum(accepted)::BIGINT AS issued, sum(accepted * (1 - correct))::BIGINT AS wrong, round(avg((accepted = 1 AND (correct = 0 OR condition = 'replace_context'))::INT), 9) AS unsafe_rate, round(avg((accepted = 1 AND correct = 1)::INT), 9) AS grounded_rate FROM decision GROUP BY 1, 2",
)
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued, right = F.col("accepted") == 1, F.col("correct") == 1
    unsafe = issued & (~right | (F.col("condition") == "replace_context"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 9)
    return V.decision(spark, sf_dir).groupBy("model", "condition").agg(F.count("*").alias("n"), F.sum("accepted").alias("issued"), F.sum(F.col("accepted") * (1 - F.col("correct"))).alias("wrong"), rate(unsafe).alias("unsafe_rate"), rate(issued & right).alias("grounded_rate"))


@query(
    "l05_method_rates",
    "SELECT method, condition, count(*) AS n, sum(a)::BIGINT AS accepted_n, round(avg(a * (1 - correct)), 9) AS wrong_rate FROM (SELECT condition, correct, method, (CASE method WHEN 'all' THEN 1 WHEN 'gate' THEN accepted ELSE (accepted = 1 AND score >= 0.1)::INT END) AS a FROM decision, (SELECT unnest(['all', 'gate', 'gate_and_margin']) AS method)) GROUP BY 1, 2",
)
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.decision(spark, sf_dir).withColumn("method", F.explode(F.array(F.lit("all"), F.lit("gate"), F.lit("gate_and_margin"))))
    a = F.when(F.col("method") == "all", 1).when(F.col("method") == "gate", F.col("accepted")).otherwise(((F.col("accepted") == 1) & (F.col("score") >= 0.1)).cast("int"))
    return d.withColumn("a", a).groupBy("method", "condition").agg(F.count("*").alias("n"), F.sum("a").alias("accepted_n"), F.round(F.avg(F.col("a") * (1 - F.col("correct"))), 9).alias("wrong_rate"))


@query(
    "l06_package_edits",
    f""", {_TOP}, dn AS (SELECT case_id, lead(case_id, 1, min_id) OVER (ORDER BY case_id) AS donor_id FROM (SELECT DISTINCT case_id, min(case_id) OVER () AS min_id FROM top))
SELECT case_id, 1 AS rank, t.entity_id FROM dn JOIN top t ON t.case_id = dn.donor_id AND t.rank = 1 UNION ALL SELECT case_id, rank + 1, entity_id FROM top""".replace("SELECT case_id, 1 AS rank, t.entity_id", "SELECT dn.case_id, 1 AS rank, t.entity_id"),
)
def l06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = packages(spark, sf_dir)
    ids = p.select("case_id")
    w = Window.orderBy("case_id")
    donors = ids.crossJoin(F.broadcast(ids.agg(F.min("case_id").alias("m")))).select("case_id", F.coalesce(F.lead("case_id").over(w), F.col("m")).alias("donor_id"))
    edited = L.with_foreign(L.without_semantics(p), donors)
    return edited.select("case_id", F.explode("candidates").alias("c")).select("case_id", "c.rank", "c.entity_id")


#: Operations whose anchors a semantic deletion takes away.
_DIAGNOSTIC = ["execve", "connect", "load"]


def proposals(p: DataFrame) -> DataFrame:
    """Packages with class probabilities: shares of the anchors by the length of their operation, the proposal ahead of the others."""
    anchors = F.flatten(F.transform("candidates", lambda c: c["anchors"]))
    seen = lambda i: F.size(F.filter(anchors, lambda a: F.length(a["operation"]) % 5 == i)) + 1
    p = p.withColumn("_w", F.array(*(seen(i) for i in range(5))))
    w = F.transform("_w", lambda x, i: F.when(i == F.length("case_id") % 5, F.array_max("_w") + 1).otherwise(x))
    p = p.withColumn("_w", w).withColumn("_s", F.aggregate("_w", F.lit(0), lambda a, x: a + x))
    shares = F.map_from_arrays(F.array(*map(F.lit, L.TACTICS)), F.transform("_w", lambda x: x / F.col("_s")))
    return L.with_confidence(p.withColumn("probabilities", shares).drop("_w", "_s"))


def _edited(p: DataFrame, edit: str) -> DataFrame:
    """What can be seen of an edit: sizes, a digest of ids and ranks, the proposal."""
    anchors = F.flatten(F.transform("candidates", lambda c: c["anchors"]))
    line = lambda c: F.concat(c["rank"].cast("string"), F.lit(":"), c["entity_id"], F.lit("["), F.array_join(F.transform(c["anchors"], lambda a: a["anchor_id"]), ","), F.lit("]"))
    return p.select(
        "case_id", F.lit(edit).alias("edit"), F.size("candidates").cast("bigint").alias("candidates_n"), F.size(anchors).cast("bigint").alias("anchors_n"),
        F.size(F.filter("candidates", lambda c: c["exe"] != "")).cast("bigint").alias("programs_n"), F.md5(F.array_join(F.transform("candidates", line), ";")).alias("ids"),
        "proposal", "confidence", "margin",
    )


_WEIGHTS = " ".join(f"count(*) FILTER (WHERE length(operation) % 5 = {i}) + 1," for i in range(5)).rstrip(",")
_NAMES = ", ".join(f"'{t}'" for t in L.TACTICS)
_EDITS = f"""{_TOP}, an AS (SELECT * FROM (SELECT e.case_id, t.rank, t.entity_id, 'a_' || substr(sha256(e.case_id || '|' || e.id || '|' || row_id), 1, 20) AS anchor_id, operation, row_number() OVER (PARTITION BY e.case_id, e.id ORDER BY abs(delta), row_id) AS k FROM ends e JOIN top t ON t.case_id = e.case_id AND t.entity_id = e.id) WHERE k <= 3),
cand AS (SELECT t.case_id, t.rank, t.entity_id, n.exe FROM top t JOIN prov_node n ON n.id = t.entity_id),
w0 AS (SELECT case_id, list_value({_WEIGHTS}) AS w FROM an GROUP BY 1),
pr AS (SELECT case_id, unnest([{_NAMES}]) AS tactic, unnest(range(5)) AS i, w, list_max(w) AS top_w FROM w0),
pw AS (SELECT case_id, tactic, CASE WHEN i = length(case_id) % 5 THEN top_w + 1 ELSE w[i + 1] END AS x, i = length(case_id) % 5 AS is_first FROM pr),
ps AS (SELECT *, x::DOUBLE / sum(x) OVER (PARTITION BY case_id) AS p, regexp_replace(case_id, '_[0-9]+$', '') AS truth FROM pw),
prop AS (SELECT case_id, max(tactic) FILTER (WHERE is_first) AS proposal, round(max(p), 6) AS confidence, round(max(p) - max(p) FILTER (WHERE NOT is_first), 6) AS margin, arg_min(tactic, (p, tactic)) FILTER (WHERE tactic <> truth) AS lie FROM ps GROUP BY 1),
don AS (SELECT a.case_id, b.case_id AS donor_id FROM (SELECT p.case_id, p.proposal, (SELECT count(*) FROM prop q WHERE q.proposal <> p.proposal) AS n FROM prop p) a
  JOIN (SELECT mine.proposal AS of, q.case_id, row_number() OVER (PARTITION BY mine.proposal ORDER BY q.proposal, q.case_id) - 1 AS place FROM (SELECT DISTINCT proposal FROM prop) mine JOIN prop q ON q.proposal <> mine.proposal) b
  ON b.of = a.proposal AND a.n > 0 AND b.place = ('0x' || substr(sha256('foreign|' || a.case_id), 1, 15))::BIGINT % a.n),
fc AS (SELECT case_id, rank + 1 AS rank, entity_id, exe, case_id AS from_case, rank AS from_rank FROM cand WHERE rank < 10
  UNION ALL SELECT d.case_id, 1, 'F_' || substr(sha256('seed|' || d.case_id || '|' || d.donor_id || '|' || c.entity_id), 1, 20), c.exe, d.donor_id, 1 FROM don d JOIN cand c ON c.case_id = d.donor_id AND c.rank = 1),
fa AS (SELECT fc.case_id, fc.rank, k, 'P' || fc.rank || '.' || operation AS stem, row_number() OVER (PARTITION BY fc.case_id, fc.rank, operation ORDER BY k) AS nth FROM fc JOIN an ON an.case_id = fc.from_case AND an.rank = fc.from_rank),
parts AS (
  SELECT c.case_id, 'none' AS edit, c.rank, c.entity_id, c.exe, a.anchor_id, a.k FROM cand c LEFT JOIN an a ON a.case_id = c.case_id AND a.rank = c.rank
  UNION ALL SELECT c.case_id, 'contradicted', c.rank, c.entity_id, c.exe, a.anchor_id, a.k FROM cand c LEFT JOIN an a ON a.case_id = c.case_id AND a.rank = c.rank
  UNION ALL SELECT c.case_id, 'renamed', c.rank, 'E_' || substr(sha256('seed|' || c.case_id || '|entity|' || c.entity_id), 1, 20), c.exe, 'A_' || substr(sha256('seed|' || c.case_id || '|anchor|' || a.anchor_id), 1, 20), a.k FROM cand c LEFT JOIN an a ON a.case_id = c.case_id AND a.rank = c.rank
  UNION ALL SELECT c.case_id, 'without_anchors', c.rank, c.entity_id, '', a.anchor_id, a.k FROM cand c LEFT JOIN an a ON a.case_id = c.case_id AND a.rank = c.rank AND a.operation NOT IN ({', '.join(f"'{x}'" for x in _DIAGNOSTIC)})
  UNION ALL SELECT fc.case_id, 'foreign', fc.rank, fc.entity_id, fc.exe, fa.stem || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END, fa.k FROM fc JOIN (SELECT case_id FROM don) d ON d.case_id = fc.case_id LEFT JOIN fa ON fa.case_id = fc.case_id AND fa.rank = fc.rank),
lines AS (SELECT case_id, edit, rank, any_value(exe) AS exe, count(anchor_id) AS anchors_n, rank || ':' || entity_id || '[' || coalesce(string_agg(anchor_id, ',' ORDER BY k), '') || ']' AS line FROM parts GROUP BY case_id, edit, rank, entity_id)"""


@query(
    "l06_all_edits",
    f""", {_EDITS} SELECT l.case_id, edit, count(*) AS candidates_n, sum(anchors_n)::BIGINT AS anchors_n, count(*) FILTER (WHERE exe <> '') AS programs_n, md5(string_agg(line, ';' ORDER BY rank)) AS ids,
  CASE WHEN edit = 'contradicted' THEN any_value(lie) ELSE any_value(proposal) END AS proposal, any_value(confidence) AS confidence, any_value(margin) AS margin FROM lines l JOIN prop p ON p.case_id = l.case_id GROUP BY 1, 2""",
)
def l06_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored(proposals(packages(spark, sf_dir)).withColumn("truth", F.regexp_replace("case_id", "_[0-9]+$", "")))
    donors = J.hashed_donor(p.select("case_id", "proposal", F.lit(0).alias("block")), "block", "case_id", "proposal", "foreign")
    edits = {"none": p, "renamed": L.renamed_ids(p, "seed"), "without_anchors": L.without_anchors(p, _DIAGNOSTIC), "contradicted": L.contradicted(p), "foreign": L.foreign_first(p, donors, "seed")}
    return functools.reduce(DataFrame.unionByName, (_edited(e, name) for name, e in edits.items()))


@query("l07_shuffled_candidates", f", {_TOP} SELECT case_id, entity_id, row_number() OVER (PARTITION BY case_id ORDER BY sha256('seed|' || case_id || '|' || entity_id)) AS rank FROM top")
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shuffled(packages(spark, sf_dir), "seed").select("case_id", F.explode("candidates").alias("c")).select("case_id", "c.entity_id", "c.rank")


_RUNS = "runs AS (SELECT case_id, r, 'e' || (('0x' || substr(md5(concat_ws('|', case_id, r)), 1, 8))::BIGINT % 3) AS entity FROM scored, (SELECT unnest([1, 2, 3]) AS r))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir).select("case_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("r"))
    return s.withColumn("entity", F.expr("concat('e', cast(conv(substring(md5(concat_ws('|', case_id, r)), 1, 8), 16, 10) as bigint) % 3)"))


_AGREEMENT = f", {_RUNS} SELECT case_id, CASE WHEN count(*) FILTER (WHERE n >= 2) = 1 THEN max(entity) FILTER (WHERE n >= 2) END AS entity FROM (SELECT case_id, entity, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1"
_STABILITY = f", {_RUNS} SELECT case_id, count(*) AS n, count(DISTINCT coalesce(entity, '-')) AS kinds, (count(DISTINCT coalesce(entity, '-')) = 1)::INT AS unanimous FROM runs GROUP BY 1"


@query("l08_agreement", _AGREEMENT)
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.agreement(runs(spark, sf_dir), 2)


@query("l09_replicate_stability", _STABILITY)
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.countDistinct(F.coalesce("entity", F.lit("-")))
    return runs(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("n"), kinds.alias("kinds"), (kinds == 1).cast("int").alias("unanimous"))


@query("l10_condition_agreement", "SELECT a.model, count(*) AS n, round(avg((a.accepted IS NOT DISTINCT FROM b.accepted)::INT), 9) AS agreement FROM decision a JOIN decision b ON a.case_id = b.case_id AND a.condition = 'clean' AND b.condition = 'shift_time' GROUP BY 1")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.decision(spark, sf_dir)
    a = d.where("condition = 'clean'").select("case_id", "model", "accepted")
    b = d.where("condition = 'shift_time'").select("case_id", F.col("accepted").alias("other"))
    return a.join(b, "case_id").groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("accepted").eqNullSafe(F.col("other")).cast("int")), 9).alias("agreement"))


@query("l11_package_audit", f", {_TOP} SELECT count(DISTINCT case_id) AS packages_n, 0::BIGINT AS repeated_cases, 0::BIGINT AS broken_ranks, 0::BIGINT AS repeated_anchors FROM top")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.audit_packages(packages(spark, sf_dir))


@query(
    "l11_planted_faults",
    f""", {_TOP}, d AS (SELECT case_id, right(case_id, 1)::INT % 4 AS fault, count(*) AS candidates_n FROM top GROUP BY 1)
SELECT count(*) + count(*) FILTER (WHERE fault = 1) AS packages_n, 2 * count(*) FILTER (WHERE fault = 1) AS repeated_cases, count(*) FILTER (WHERE fault = 2) AS broken_ranks, count(*) FILTER (WHERE fault = 3) AS repeated_anchors FROM d""",
)
def l11_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the last digit of the case number modulo 4: one package more, ranks from 2, every anchor twice."""
    p = packages(spark, sf_dir).withColumn("fault", F.substring("case_id", -1, 1).cast("int") % 4)
    twice = F.transform("candidates", lambda c: c.withField("anchors", F.concat(c["anchors"], c["anchors"])))
    late = F.transform("candidates", lambda c: c.withField("rank", c["rank"] + 1))
    p = p.withColumn("candidates", F.when(F.col("fault") == 2, late).when(F.col("fault") == 3, twice).otherwise(F.col("candidates")))
    return L.audit_packages(p.union(p.where("fault = 1")))


@query(
    "l12_evidence_audit",
    f""", {_GRAPH} SELECT count(*) AS entities_n, (SELECT count(*) FROM rel WHERE src NOT IN (SELECT id FROM prov_node) OR dst NOT IN (SELECT id FROM prov_node)) AS dangling, (SELECT count(*) FROM (SELECT case_id, row_id FROM rel GROUP BY ALL HAVING count(*) > 1)) AS repeated_relations,
  (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n, case_id) - 1 AS place, count(*) OVER () AS total FROM (SELECT case_id, count(*) AS n FROM ent GROUP BY 1)) WHERE place = round_even(0.9::DOUBLE * (total - 1), 0)) AS p90_entities FROM ent""",
)
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = relations(spark, sf_dir)
    e, nodes = entities(spark, sf_dir, r), V.prov_node(spark, sf_dir).select("id")
    dangling = r.join(nodes, r.src == nodes.id, "left_anti").select("case_id", "row_id").union(r.join(nodes, r.dst == nodes.id, "left_anti").select("case_id", "row_id")).distinct().agg(F.count("*").alias("dangling"))
    repeated = r.groupBy("case_id", "row_id").count().where("count > 1").agg(F.count("*").alias("repeated_relations"))
    per = e.groupBy("case_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    ranked = per.withColumns({"place": F.row_number().over(w.orderBy("n", "case_id")) - 1, "total": F.count("*").over(w)})
    p90 = ranked.where(F.col("place") == F.bround(F.lit(0.9) * (F.col("total") - 1), 0)).select(F.col("n").alias("p90_entities"))
    return e.agg(F.count("*").alias("entities_n")).crossJoin(dangling).crossJoin(repeated).crossJoin(p90)


@query(
    "l13_payloads",
    f""", {_TOP}, an AS (SELECT e.case_id, e.id, '{{"anchor_id":"a_' || substr(sha256(e.case_id || '|' || e.id || '|' || row_id), 1, 20) || '","operation":"' || operation || '"}}' AS a, row_number() OVER (PARTITION BY e.case_id, e.id ORDER BY abs(delta), row_id) AS k FROM ends e),
cn AS (SELECT t.case_id, t.rank, '{{"anchors":[' || string_agg(a, ',' ORDER BY k) || '],"entity_id":"' || t.entity_id || '","exe":"' || any_value(n.exe) || '","rank":' || t.rank || '}}' AS c FROM top t JOIN prov_node n ON n.id = t.entity_id JOIN an ON an.case_id = t.case_id AND an.id = t.entity_id AND k <= 3 GROUP BY t.case_id, t.rank, t.entity_id)
SELECT case_id, md5('{{"candidates":[' || string_agg(c, ',' ORDER BY rank) || '],"case_id":"' || case_id || '"}}') AS digest FROM cn GROUP BY 1""",
)
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.payload(packages(spark, sf_dir)).select("case_id", F.md5("payload").alias("digest"))


_REC = "rec AS (SELECT (event_id // 2 * CASE WHEN k % 50 = 0 THEN 1 ELSE 2 END + CASE WHEN k % 50 = 0 THEN 0 ELSE event_id % 2 END)::BIGINT AS id, CASE WHEN k % 7 = 0 THEN '' ELSE event_type END AS name, CASE k % 5 WHEN 0 THEN 'READY' WHEN 1 THEN 'FAILED_X' WHEN 2 THEN 'odd' ELSE 'DONE' END AS status, CASE WHEN k % 11 = 0 THEN 'zz' ELSE sha256(event_id::VARCHAR) END AS sha256 FROM base)"


@query(
    "l14_record_errors",
    f""", {_REC}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM rec) SELECT error, count(*) AS n FROM (SELECT 'missing:name' AS error FROM n WHERE name = '' UNION ALL SELECT 'unknown_status' FROM n WHERE status = 'odd' UNION ALL SELECT 'bad_hash' FROM n WHERE sha256 = 'zz' UNION ALL SELECT 'repeated_id' FROM n WHERE c > 1) GROUP BY 1""",
)
def l14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = V.base(spark, sf_dir).selectExpr(
        "cast(event_id div 2 * CASE WHEN k % 50 = 0 THEN 1 ELSE 2 END + CASE WHEN k % 50 = 0 THEN 0 ELSE event_id % 2 END as bigint) AS id", "CASE WHEN k % 7 = 0 THEN '' ELSE event_type END AS name",
        "CASE k % 5 WHEN 0 THEN 'READY' WHEN 1 THEN 'FAILED_X' WHEN 2 THEN 'odd' ELSE 'DONE' END AS status", "CASE WHEN k % 11 = 0 THEN 'zz' ELSE sha2(cast(event_id as string), 256) END AS sha256",
    )
    return L.record_errors(rec, ["id", "name"], ["READY", "DONE"]).groupBy("error").agg(F.count("*").alias("n"))


@query("l15_serialised_size", "SELECT source, count(*) AS docs_n, sum(octet_length(encode(text)))::BIGINT AS text_bytes, round(sum(octet_length(encode(text))) / count(*), 6) AS per_doc FROM documents GROUP BY 1")
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    b = F.sum(F.octet_length("text"))
    return d.groupBy("source").agg(F.count("*").alias("docs_n"), b.alias("text_bytes"), F.round(b / F.count("*"), 6).alias("per_doc"))


@query(
    "l15_package_sizes",
    f""", {_TOP}, an AS (SELECT e.case_id, e.id, '{{"anchor_id":"a_' || substr(sha256(e.case_id || '|' || e.id || '|' || row_id), 1, 20) || '","operation":"' || operation || '"}}' AS a, row_number() OVER (PARTITION BY e.case_id, e.id ORDER BY abs(delta), row_id) AS k FROM ends e),
cn AS (SELECT t.case_id, t.rank, '{{"anchors":[' || string_agg(a, ',' ORDER BY k) || '],"entity_id":"' || t.entity_id || '","exe":"' || any_value(n.exe) || '","rank":' || t.rank || '}}' AS c FROM top t JOIN prov_node n ON n.id = t.entity_id JOIN an ON an.case_id = t.case_id AND an.id = t.entity_id AND k <= 3 GROUP BY t.case_id, t.rank, t.entity_id),
cb AS (SELECT case_id, octet_length(encode('{{"candidates":[' || string_agg(c, ',' ORDER BY rank) || '],"case_id":"' || case_id || '"}}')) + 1 AS b, right(case_id, 1)::INT % 5 = 0 AS yes FROM cn GROUP BY 1),
fb AS (SELECT case_id, sum(octet_length(encode('{{"row_id":' || row_id || ',"src":"' || src || '","dst":"' || dst || '","relation":"' || relation || '","operation":"' || operation || '"}}')) + 1) AS f FROM rel GROUP BY 1)
SELECT count(*) AS cases_n, count(*) FILTER (WHERE yes) AS accepted_n, sum(f)::BIGINT AS full_bytes, sum(b)::BIGINT AS compact_bytes, coalesce(sum(b) FILTER (WHERE yes), 0)::BIGINT AS accepted_bytes,
  round(sum(b) / sum(f), 9) AS compact_share, round(coalesce(sum(b) FILTER (WHERE yes), 0) / sum(b), 9) AS accepted_share FROM cb JOIN fb USING (case_id)""",
)
def l15_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packages(spark, sf_dir)
    accepted = L.check_certificates(responses(p), p).where("decision = 'attribute'")
    return L.package_sizes(p, relations(spark, sf_dir).select("case_id", "row_id", "src", "dst", "relation", "operation"), accepted)
