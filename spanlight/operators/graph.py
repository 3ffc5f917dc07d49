"""Candidate graphs around incident cases: entities, features and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.functions import scalars as S
from spanlight.operators.joins import within


def case_relations(cases: DataFrame, edges: DataFrame, radius: float, offset: float = 0.0) -> DataFrame:
    """Relations whose time lies within ``radius`` of a case's anchor, moved back by ``offset``; signed delta."""
    centre = cases.withColumn("_centre", F.col("anchor") - offset)
    return within(centre, edges, "_centre", "ts_s", radius).withColumn("delta", F.col("ts_s") - F.col("_centre")).drop("_centre")


def offset_relations(cases: DataFrame, edges: DataFrame, radius: float, offsets: list[float]) -> DataFrame:
    """``case_relations`` for every clock offset, with ``offset_s``, from one join.

    A relation at distance d from an anchor is inside for the offsets from -radius - d to radius - d. So the views are joined
    once, as far out as the largest offset reaches, and a pair becomes a row only for the offsets at which it is inside.
    """
    reach = max(map(abs, offsets), default=0.0)
    wide = within(cases, edges, "anchor", "ts_s", radius + reach).withColumn("_d", F.col("ts_s") - F.col("anchor"))
    moved = F.transform(F.array(*(F.lit(o) for o in offsets)), lambda o: F.struct(o.alias("offset_s"), (F.col("ts_s") - (F.col("anchor") - o)).alias("delta")))
    return wide.withColumn("_o", F.explode(F.filter(moved, lambda m: F.abs(m["delta"]) <= radius))).select("*", "_o.*").drop("_o", "_d")


def drift(relations: DataFrame, nodes: DataFrame, cases: DataFrame, offsets: list[float], radius: float, least_margin: float, k: int = 10) -> DataFrame:
    """Each case at each offset: its processes ranked anew, and whether what supported it at offset 0 is still among the first ``k``.

    ``relations`` come from ``offset_relations``. ``temporal`` tells whether there are processes and one of the first three is near in time,
    ``margin`` is the lead of the best, ``correct`` whether it is labelled; ``primary``, ``gate`` and ``margin_only`` are the three policies.
    """
    processes = nodes.where("type = 'Process'").select("id", "label")
    per = ends(relations).join(processes, "id").groupBy("offset_s", "case_id", "id", "label").agg(F.count("*").alias("incident"), F.min(F.abs("delta")).alias("closest"))
    proximity = F.greatest(F.lit(0.0), 1 - F.col("closest") / radius)
    scored = per.withColumns({"proximity": proximity, "score": F.round(F.log1p("incident") + proximity, 6)})
    r = F.row_number().over(Window.partitionBy("offset_s", "case_id").orderBy(F.desc("score"), "id"))
    top = scored.withColumn("r", r).where(F.col("r") <= k)
    support = top.where("offset_s = 0 and r = 1").select("case_id", F.col("id").alias("support_id"))
    first, second = (F.max(F.when(F.col("r") == i, F.col("score"))) for i in (1, 2))
    found = top.join(support, "case_id", "left").groupBy("offset_s", "case_id").agg(
        (F.avg(F.when(F.col("r") <= 3, F.col("proximity"))) > 0).alias("temporal"), F.max(F.coalesce(F.col("id") == F.col("support_id"), F.lit(False))).alias("kept"),
        (first - F.coalesce(second, F.lit(0.0))).alias("margin"), F.max(F.when(F.col("r") == 1, F.col("label"))).alias("correct"),
    )
    every = cases.select("case_id", F.explode(F.array(*(F.lit(o) for o in offsets))).alias("offset_s"))
    out = every.join(found, ["offset_s", "case_id"], "left").na.fill(False, ["temporal", "kept"]).na.fill(0, ["margin", "correct"])
    lead = F.col("margin") >= least_margin
    return out.withColumns({"primary": F.col("kept") & F.col("temporal") & lead, "gate": F.col("temporal") & lead, "margin_only": lead})


def count_maps(entities: DataFrame, relations: DataFrame, owner: str) -> DataFrame:
    """G3, in long form: ``owner, field, key, n`` of entity kinds, relation types and operations."""
    part = lambda df, field, key: df.groupBy(owner, F.lit(field).alias("field"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return part(entities, "kinds", "kind").unionByName(part(relations, "types", "relation")).unionByName(part(relations, "operations", "operation"))


def merged_graphs(pairs: DataFrame, entities: DataFrame, relations: DataFrame, donor_entities: DataFrame, donor_relations: DataFrame) -> DataFrame:
    """The graph of each case with its donor's put in (``pairs``: ``case_id, band, donor_id``), as merged counts.

    Maps are merged by key: a case's and its donor's counts of one kind, type or operation add up. Donor entities keep to
    themselves, since their ids get the donor's name; how many processes they bring is ``injected``.
    """
    own = count_maps(entities, relations, "case_id").join(pairs, "case_id").select("case_id", "band", "field", "key", "n", F.lit(0).alias("from_donor"))
    other = count_maps(donor_entities, donor_relations, "donor_id").join(pairs, "donor_id").select("case_id", "band", "field", "key", "n", F.lit(1).alias("from_donor"))
    both = own.unionByName(other).groupBy("case_id", "band", "field", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("from_donor")).alias("added"))
    text = lambda f: F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.concat_ws("=", "key", "n")))), ","), F.lit("")).alias(f)
    total = lambda f: F.sum(F.when(F.col("field") == f, F.col("n")).otherwise(0))
    process = (F.col("field") == "kinds") & (F.col("key") == "process")
    return both.groupBy("case_id", "band").agg(total("kinds").alias("entities_n"), total("types").alias("relations_n"), F.sum(F.when(process, F.col("added")).otherwise(0)).alias("injected"), text("kinds"), text("types"), text("operations"))


def ends(relations: DataFrame) -> DataFrame:
    """A row for each end of each relation: ``id``, the ``other`` end and whether the edge leaves ``id``."""
    out = F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("out"))
    into = F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).alias("out"))
    return relations.withColumn("_e", F.explode(F.array(out, into))).select("*", "_e.*").drop("_e")


def entity_features(relations: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """G1: degrees, nearness in time and scores of each node that a case's relations touch."""
    e = ends(relations).groupBy("case_id", "id").agg(
        F.sum(1 - F.col("out")).alias("in_degree"), F.sum("out").alias("out_degree"), F.min(F.abs("delta")).alias("closest")
    )
    e = e.join(nodes.select("id", S.entity_kind(F.col("type"), F.col("subtype")).alias("kind"), "label"), "id")
    incident = F.col("in_degree") + F.col("out_degree")
    proximity = F.greatest(F.lit(0.0), 1 - F.col("closest") / max(radius, 1))
    return e.withColumns({"incident": incident, "proximity": proximity, "degree_score": F.log1p(incident), "recency_degree": F.log1p(incident) + proximity})


def matches(features: DataFrame, nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Whether an entity's address or port is among all values of the case's alert window (``case_id, dimension, value``)."""
    own = nodes.select("id", F.explode(F.array(F.struct(F.lit("ip").alias("dimension"), F.col("remote_ip").alias("value")), F.struct(F.lit("port").alias("dimension"), F.col("remote_port").cast("string").alias("value")))).alias("v")).select("id", "v.*").where("value is not null")
    seen = values.select("case_id", "dimension", "value").distinct()
    hit = features.select("case_id", "id").join(own, "id").join(seen, ["case_id", "dimension", "value"], "left_semi")
    flags = hit.groupBy("case_id", "id").agg(F.max((F.col("dimension") == "ip").cast("int")).alias("address_match"), F.max((F.col("dimension") == "port").cast("int")).alias("port_match"))
    return features.join(flags, ["case_id", "id"], "left").na.fill(0, ["address_match", "port_match"])


def process_context(relations: DataFrame, features: DataFrame, nodes: DataFrame) -> DataFrame:
    """What surrounds each process of a case: kinds, relations, operations, matched sockets, files and times."""
    f = features.select("case_id", "id", "kind", "address_match", "port_match", "proximity")
    near = f.select("case_id", F.col("id").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("kind", "address_match", "port_match", "proximity")))
    paths = nodes.select(F.col("id").alias("other"), "path")
    rows = ends(relations).join(f.where("kind = 'process'").select("case_id", "id"), ["case_id", "id"]).join(near, ["case_id", "other"]).join(paths, "other")
    n = lambda cond: F.count_if(cond)
    kind, path = F.col("o_kind"), F.col("path")
    socket, file = kind == "socket", kind == "file"
    group = S.operation_group(F.col("operation"))
    return rows.groupBy("case_id", "id").agg(
        *(n(kind == k).alias(f"near_{k}") for k in ("process", "file", "socket")),
        *(n(F.col("relation") == r).alias(f"relation_{r}") for r in S.RELATION_TYPES),
        *(n(group == g).alias(f"operation_{g}") for g in S.OPERATION_GROUPS),
        n(socket & (F.col("o_address_match") == 1)).alias("socket_address"), n(socket & (F.col("o_port_match") == 1)).alias("socket_port"),
        n(socket & (F.col("o_address_match") == 1) & (F.col("o_port_match") == 1)).alias("socket_both"),
        F.coalesce(F.max(F.when(socket, F.col("o_proximity"))), F.lit(0.0)).alias("socket_proximity"),
        n(file & S.starts_with_any(path, S.TMP_FILES)).alias("file_tmp"), n(file & S.starts_with_any(path, S.HOME_FILES)).alias("file_home"), n(file & S.starts_with_any(path, S.SYSTEM_FILES)).alias("file_system"),
        F.min(F.abs("delta")).alias("min_delta"), n(F.col("delta") < 0).alias("before_n"), n(F.col("delta") >= 0).alias("after_n"),
    )


def process_vector(features: DataFrame, context: DataFrame, nodes: DataFrame, alerts: DataFrame) -> DataFrame:
    """The 55 features of each process of a case as columns: own, utility, context, relation, operation and alert ones.

    ``nodes`` has ``name`` and ``parent_pid``; a null one is empty.
    """
    named = nodes.select("id", "exe", "name", "parent_pid", *(c.alias(n) for n, c in S.path_features(F.col("exe"), F.col("name")).items()))
    rows = features.where("kind = 'process'").join(context, ["case_id", "id"], "left").join(named, "id").join(alerts, "case_id")
    counts = [c for c in context.columns if c not in ("case_id", "id")]
    rows = rows.na.fill(0, counts)
    log = F.log1p
    own = {
        "time_proximity": F.col("proximity"), "log_closest": log("closest"), "f_degree_score": F.col("degree_score"), "f_recency_degree": F.col("recency_degree"),
        "log_incident": log("incident"), "log_in": log("in_degree"), "log_out": log("out_degree"), "in_fraction": F.col("in_degree") / F.greatest(F.col("incident"), F.lit(1)),
        "path_depth": F.col("depth"), "name_length_log": log(F.coalesce(F.length("name"), F.lit(0))), "exe_length_log": log(F.length("exe")), "f_system_binary": F.col("is_system_binary"), "f_user_binary": F.col("is_user_binary"), "has_parent": (F.coalesce(F.col("parent_pid"), F.lit("")) != "").cast("int"),
    }
    near = {f"log_{c}": log(c) for c in ("near_process", "near_file", "near_socket", "socket_address", "socket_port", "socket_both")}
    near |= {"max_socket_proximity": F.col("socket_proximity")} | {f"log_{c}": log(c) for c in ("file_tmp", "file_home", "file_system", "min_delta")}
    near["before_fraction"] = F.col("before_n") / F.greatest(F.col("before_n") + F.col("after_n"), F.lit(1))
    rest = {f"log_{c}": log(c) for c in counts if c.startswith(("relation_", "operation_"))}
    alert = {"alert_rows_log": log(F.greatest(F.col("alert_rows"), F.lit(1)))} | {c: F.col(c) for c in alerts.columns if c not in ("case_id", "alert_rows")}
    utility = {f"utility_{g}": F.col(f"utility_{g}") for g in S.UTILITY_GROUPS}
    return rows.select("case_id", "id", *((c.cast("double")).alias(n) for n, c in (own | utility | near | rest | alert).items()))


def ranked_summary(scored: DataFrame, vector: list[str], k: int = 3) -> DataFrame:
    """Score-weighted mean of the top ``k`` vectors, margin, entropy and mass of the top of each case (``case_id, id, score``)."""
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "id")
    whole = Window.partitionBy("case_id")
    share = F.col("score") / F.when(F.sum("score").over(whole) > 0, F.sum("score").over(whole))
    ranked = scored.withColumns({"_r": F.row_number().over(order), "_p": share})
    top = F.col("_r") <= k
    p = F.greatest(F.least(F.col("_p"), F.lit(1.0)), F.lit(1e-12))
    aggs = [(F.sum(F.when(top, F.col("score") * F.col(c))) / F.when(F.sum(F.when(top, F.col("score"))) > 0, F.sum(F.when(top, F.col("score"))))).alias(f"top_{c}") for c in vector]
    first, second = (F.max(F.when(F.col("_r") == i, F.col("score"))) for i in (1, 2))
    return ranked.groupBy("case_id").agg(*aggs, (first - F.coalesce(second, F.lit(0.0))).alias("margin"), (-F.sum(p * F.log(p))).alias("entropy"), F.sum(F.when(top, F.col("_p"))).alias("top_mass"), F.count("*").alias("candidates"))


def rank_stability(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """Jaccard of the top ``k`` ids of a case under two scorings."""

    def tops(df: DataFrame, name: str) -> DataFrame:
        r = df.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= k)
        return r.groupBy("case_id").agg(F.collect_set("id").alias(name))

    both = tops(a, "x").join(tops(b, "y"), "case_id")
    return both.select("case_id", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def packages(features: DataFrame, relations: DataFrame, nodes: DataFrame, k: int = 10, anchors: int = 3) -> DataFrame:
    """Nested package of each case: the ``k`` best processes with their nearest relations as anchors."""
    order = Window.partitionBy("case_id").orderBy(F.desc("recency_degree"), "id")
    best = features.where("kind = 'process'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = Window.partitionBy("case_id", "id").orderBy(F.abs("delta"), "row_id")
    found = ends(relations).join(best.select("case_id", "id"), ["case_id", "id"], "left_semi").withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= anchors)
    anchor = F.struct("_n", S.opaque_id("a", F.col("case_id"), F.col("id"), F.col("row_id").cast("string")).alias("anchor_id"), "relation", "operation", F.round("delta", 6).alias("delta"))
    listed = found.groupBy("case_id", "id").agg(F.array_sort(F.collect_list(anchor)).alias("anchors"))
    rows = best.join(listed, ["case_id", "id"], "left").join(nodes.select("id", "exe"), "id")
    candidate = F.struct("rank", F.col("id").alias("entity_id"), "exe", F.round("recency_degree", 6).alias("score"), F.coalesce("anchors", F.array()).alias("anchors"))
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"), F.count("*").alias("candidate_count"))


def sparse_features(top: DataFrame, token: Column) -> DataFrame:
    """``case_id, feature, value`` with each candidate's tokens weighted by one over its rank."""
    return top.select("case_id", F.explode(token).alias("feature"), (1 / F.col("rank")).alias("w")).groupBy("case_id", "feature").agg(F.sum("w").alias("value"))
