"""Nested evidence packages and the certificates that answer them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.functions import scalars as S

# What a certificate may say.
TACTICS = ["collection", "command_and_control", "credential_access", "discovery", "exfiltration"]
REASONS = [
    "sufficient_observed_support",
    "missing_process_evidence",
    "insufficient_process_evidence",
    "conflicting_cross_view_evidence",
    "temporal_mismatch",
    "ambiguous_tactic",
    "suspected_evidence_corruption",
]
KEYS = {
    "1.0": ["schema_version", "case_id", "decision", "tactic", "evidence_sufficient", "integrity_alarm", "confidence", "cited_entity_ids", "cited_anchor_ids", "reason_codes"],
    "2.0": ["schema_version", "case_id", "tactic", "evidence_sufficient", "integrity_alarm", "confidence", "cited_entity_ids", "cited_anchor_ids", "reason_codes"],
    "3.0": ["schema_version", "case_id", "tactic", "evidence_sufficient", "integrity_alarm", "confidence", "support_process_ref", "cited_anchor_ids", "reason_codes"],
}
MAX_ENTITIES = {"1.0": 3, "2.0": 5, "3.0": 1}
MAX_ANCHORS = {"1.0": 6, "2.0": 30, "3.0": 6}
# Error codes by what they say about a certificate.
CATEGORY_CODES = {
    "evidence_obligation": ["attribute_without_observed_anchor", "attribute_without_sufficiency"],
    "missing_process_refusal": ["missing_process_without_integrity_alarm"],
    "reference_ownership": ["hallucinated_process_ref", "hallucinated_entity_id", "hallucinated_anchor_id", "anchor_owner_not_cited"],
    "decision_or_schema": ["invalid_tactic", "invalid_decision", "invalid_reason_codes", "case_id_mismatch"],
}


def first_json(texts: Column) -> Column:
    """L1: ``(json, trailing)``: the first complete JSON object in free text and whether text follows it."""

    @F.pandas_udf("json string, trailing boolean")
    def scan(column: pd.Series) -> pd.DataFrame:
        decoder, out = json.JSONDecoder(), []
        for text in column:
            found = (None, False)
            at = (text or "").find("{")
            while at >= 0:
                try:
                    _, end = decoder.raw_decode(text, at)
                    found = (text[at:end], bool(text[end:].strip()))
                    break
                except ValueError:
                    at = text.find("{", at + 1)
            out.append(found)
        return pd.DataFrame(out, columns=["json", "trailing"])

    return scan(texts)


def _all(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def check_certificates(responses: DataFrame, packages: DataFrame) -> DataFrame:
    """L2: ``case_id, decision, valid, errors`` of each response against the package of its case.

    ``responses`` has ``case_id`` (the case that was asked about) and ``response`` (JSON text);
    ``packages`` has ``case_id``, ``candidates`` (array of rank, entity_id, anchors with
    anchor_id), ``candidate_count`` and ``proposal``. Key sets, types, ranges, citations,
    ownership and the rules for attributing and abstaining are array functions after one join.
    """
    r = F.col("response")
    raw = lambda k: F.get_json_object(r, f"$.{k}")
    # What is a JSON string, boolean, number or list shows only in the map of raw values.
    typed = responses.join(packages, "case_id", "left").withColumns(
        {
            "_v": F.coalesce(raw("schema_version"), F.lit("")),
            "_keys": F.coalesce(F.expr("json_object_keys(response)"), F.array().cast("array<string>")),
            "_tactic": raw("tactic"),
            "_sufficient": raw("evidence_sufficient"),
            "_alarm": raw("integrity_alarm"),
            "_confidence": raw("confidence").try_cast("double"),
            "_ref": raw("support_process_ref"),
            "_anchors": F.from_json(raw("cited_anchor_ids"), "array<string>"),
            "_cited": F.from_json(raw("cited_entity_ids"), "array<string>"),
            "_reasons": F.from_json(raw("reason_codes"), "array<string>"),
        }
    )
    v3 = F.col("_v") == "3.0"
    expected = F.when(v3, F.array(*map(F.lit, KEYS["3.0"]))).when(F.col("_v") == "2.0", F.array(*map(F.lit, KEYS["2.0"]))).otherwise(F.array(*map(F.lit, KEYS["1.0"])))
    refs = F.map_from_entries(F.transform("candidates", lambda c: F.struct(F.concat(F.lit("P"), c["rank"].cast("string")), c["entity_id"])))
    owners = F.flatten(F.transform("candidates", lambda c: F.transform(c["anchors"], lambda a: F.struct(a["anchor_id"].alias("anchor"), c["entity_id"].alias("owner")))))
    tactic = F.col("_tactic")
    known_tactic = F.coalesce(tactic.isin(TACTICS), F.lit(False))
    decision = F.when(F.col("_v").isin("2.0", "3.0"), F.when(known_tactic, "attribute").when(tactic.isNull(), "abstain")).otherwise(F.when(raw("decision").isin("attribute", "abstain"), raw("decision")))
    typed = typed.withColumns({"_expected": expected, "_refs": refs, "_owners": owners, "_decision": decision})
    by_ref = F.try_element_at("_refs", F.col("_ref"))
    typed = typed.withColumn("_entities", F.when(v3, F.when(by_ref.isNotNull(), F.array(by_ref)).otherwise(F.array().cast("array<string>"))).otherwise(_all(F.col("_cited"))))
    missing, extra = F.array_except("_expected", "_keys"), F.array_except("_keys", "_expected")
    entities, anchors, reasons = F.col("_entities"), _all(F.col("_anchors")), _all(F.col("_reasons"))
    ids = F.transform("candidates", lambda c: c["entity_id"])
    anchor_ids = F.transform("_owners", lambda o: o["anchor"])
    limit = lambda table: F.when(v3, table["3.0"]).when(F.col("_v") == "2.0", table["2.0"]).otherwise(table["1.0"])
    attribute, abstain = F.col("_decision") == "attribute", F.col("_decision") == "abstain"
    flag = lambda c: F.coalesce(F.col(c).isin("true", "false"), F.lit(False))
    uncited = F.exists("_owners", lambda o: F.array_contains(anchors, o["anchor"]) & ~F.array_contains(entities, o["owner"]))
    rules = [
        (F.size(missing) > 0, F.concat(F.lit("missing_keys:"), F.array_join(F.array_sort(missing), ","))),
        (F.size(extra) > 0, F.concat(F.lit("extra_keys:"), F.array_join(F.array_sort(extra), ","))),
        (~F.col("_v").isin("1.0", "2.0", "3.0"), "invalid_schema_version"),
        (~raw("case_id").eqNullSafe(F.col("case_id")), "case_id_mismatch"),
        (F.col("_decision").isNull(), "invalid_decision"),
        (tactic.isNotNull() & ~known_tactic, "invalid_tactic"),
        (~flag("_sufficient"), "invalid_evidence_sufficient"),
        (~flag("_alarm"), "invalid_integrity_alarm"),
        (F.col("_confidence").isNull(), "invalid_confidence_type"),
        (~F.col("_confidence").between(0, 1), "invalid_confidence_range"),
        (v3 & F.col("_ref").isNotNull() & by_ref.isNull(), "hallucinated_process_ref"),
        (~v3 & F.col("_cited").isNull(), "invalid_cited_entity_ids"),
        (F.col("_anchors").isNull(), "invalid_cited_anchor_ids"),
        (F.col("_reasons").isNull() | ~F.size(reasons).between(1, 3) | (F.size(F.array_except(reasons, F.array(*map(F.lit, REASONS)))) > 0), "invalid_reason_codes"),
        ((F.size(entities) > limit(MAX_ENTITIES)) | (F.size(F.array_distinct(entities)) < F.size(entities)), "invalid_entity_citation_cardinality"),
        ((F.size(anchors) > limit(MAX_ANCHORS)) | (F.size(F.array_distinct(anchors)) < F.size(anchors)), "invalid_anchor_citation_cardinality"),
        (F.when(v3, F.col("_ref").isNotNull() & by_ref.isNull()).otherwise(F.size(F.array_except(entities, ids)) > 0), "hallucinated_entity_id"),
        (F.size(F.array_except(anchors, anchor_ids)) > 0, "hallucinated_anchor_id"),
        (uncited, "anchor_owner_not_cited"),
        (attribute & ~known_tactic, "attribute_without_valid_tactic"),
        (attribute & ~F.col("_sufficient").eqNullSafe(F.lit("true")), "attribute_without_sufficiency"),
        (attribute & ((F.size(entities) == 0) | (F.size(anchors) == 0)), "attribute_without_observed_anchor"),
        (attribute & F.col("proposal").isNotNull() & ~tactic.eqNullSafe(F.col("proposal")), "tactic_differs_from_machine_proposal"),
        (abstain & tactic.isNotNull(), "abstain_with_tactic"),
        (abstain & ~F.col("_sufficient").eqNullSafe(F.lit("false")), "abstain_marked_sufficient"),
        (abstain & v3 & (F.col("_ref").isNotNull() | (F.size(anchors) > 0)), "abstain_with_support_citation"),
        ((F.coalesce("candidate_count", F.lit(0)) == 0) & ~F.col("_alarm").eqNullSafe(F.lit("true")), "missing_process_without_integrity_alarm"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in rules)))
    errors = F.when(r.isNull() | F.expr("json_object_keys(response)").isNull(), F.array(F.lit("missing_response"))).otherwise(F.array_sort(F.array_distinct(found)))
    out = typed.withColumn("errors", errors)
    valid = F.size("errors") == 0
    return out.select(*responses.columns, F.when(valid & attribute, "attribute").otherwise("abstain").alias("decision"), valid.alias("valid"), "errors")


def failure_taxonomy(checked: DataFrame, keys: list[str]) -> DataFrame:
    """L3: counts and rates of failed rows and of each category of errors; categories overlap."""
    flags = {name: F.arrays_overlap("errors", F.array(*map(F.lit, codes))) for name, codes in CATEGORY_CODES.items()}
    n = F.count("*")
    aggs = [n.alias("n"), F.count_if(~F.col("valid")).alias("failed")]
    for name, f in flags.items():
        aggs += [F.count_if(f).alias(name), (F.count_if(f) / n).alias(f"{name}_rate")]
    return checked.groupBy(*keys).agg(*aggs)


def agreement(runs: DataFrame, least: int) -> DataFrame:
    """The entity that at least ``least`` runs of a case chose, null unless it is the only one."""
    n = runs.where("entity is not null").groupBy("case_id", "entity").agg(F.count("*").alias("n"))
    won = n.groupBy("case_id").agg(F.count_if(F.col("n") >= least).alias("w"), F.max(F.when(F.col("n") >= least, F.col("entity"))).alias("e"))
    return runs.select("case_id").distinct().join(won, "case_id", "left").select("case_id", F.when(F.col("w") == 1, F.col("e")).alias("entity"))


def without_semantics(packages: DataFrame) -> DataFrame:
    """Every candidate without its program and its anchors' operations."""
    bare = F.transform("candidates", lambda c: c.withField("exe", F.lit("")).withField("anchors", F.transform(c["anchors"], lambda a: a.withField("operation", F.lit("")))))
    return packages.withColumn("candidates", bare)


def renamed_references(packages: DataFrame, start: int = 1) -> DataFrame:
    """Candidates get fresh ranks from ``start`` in their present order."""
    return packages.withColumn("candidates", F.transform("candidates", lambda c, i: c.withField("rank", (i + start).cast("int"))))


def shuffled(packages: DataFrame, seed: str) -> DataFrame:
    """Candidates in the order of a hash of (seed, case, entity), with fresh ranks."""
    keyed = F.transform("candidates", lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col("case_id"), c["entity_id"]), 256).alias("h"), c.alias("c")))
    ordered = F.transform(F.array_sort(keyed), lambda x, i: x["c"].withField("rank", (i + 1).cast("int")))
    return packages.withColumn("candidates", ordered)


def with_foreign(packages: DataFrame, donors: DataFrame) -> DataFrame:
    """The donor case's best candidate put in front (``case_id, donor_id``), ranks renewed."""
    best = packages.select(F.col("case_id").alias("donor_id"), F.element_at("candidates", 1).alias("_f"))
    j = packages.join(donors, "case_id").join(best, "donor_id")
    return renamed_references(j.withColumn("candidates", F.concat(F.array("_f"), "candidates"))).drop("_f")


def renamed_ids(packages: DataFrame, seed: str) -> DataFrame:
    """Entity and anchor ids replaced by opaque ones that depend on the seed and the case; ranks and order stay."""
    fresh = lambda prefix, kind, old: S.opaque_id(prefix, F.lit(seed), F.col("case_id"), F.lit(kind), old)
    renamed = F.transform("candidates", lambda c: c.withField("entity_id", fresh("E", "entity", c["entity_id"])).withField("anchors", F.transform(c["anchors"], lambda a: a.withField("anchor_id", fresh("A", "anchor", a["anchor_id"])))))
    return packages.withColumn("candidates", renamed)


def without_anchors(packages: DataFrame, diagnostic: list[str]) -> DataFrame:
    """Every candidate without its program and without the anchors whose operation is in ``diagnostic``; others stay as they are.

    An anchor without an operation stays.
    """
    kept = lambda a: ~F.coalesce(a["operation"].isin(diagnostic), F.lit(False))
    return packages.withColumn("candidates", F.transform("candidates", lambda c: c.withField("exe", F.lit("")).withField("anchors", F.filter(c["anchors"], kept))))


def with_confidence(packages: DataFrame) -> DataFrame:
    """``proposal`` of each package's ``probabilities`` (a map by class), its ``confidence`` and ``margin`` over the second class, to six digits.

    Ties go to the smaller name; no classes give nulls, one class a margin over zero.
    """
    entries = F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    best = F.array_sort(entries)
    first, second = F.try_element_at(best, F.lit(1)), F.try_element_at(best, F.lit(2))
    margin = F.coalesce(second["v"], F.lit(0.0)) - first["v"]
    return packages.withColumns({"proposal": first["k"], "confidence": F.round(-first["v"], 6), "margin": F.round(margin, 6)})


def contradicted(packages: DataFrame, truth: str = "truth") -> DataFrame:
    """The least probable class that is not ``truth`` takes the proposal's place, and the two change their probabilities.

    Equal probabilities go to the smaller name. Where truth is null every class may be taken; a
    package without another class keeps its proposal. ``confidence`` and ``margin`` follow from the
    probabilities as they are afterwards.
    """
    others = F.filter(F.map_entries("probabilities"), lambda e: ~e["key"].eqNullSafe(F.col(truth)))
    least = F.array_min(F.transform(others, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    false = F.coalesce(least["k"], F.col("proposal"))
    of = lambda k: F.try_element_at(F.col("probabilities"), k)
    swapped = F.transform_values("probabilities", lambda k, v: F.when(k == false, of(F.col("proposal"))).when(k == F.col("proposal"), of(false)).otherwise(v))
    best = F.array_sort(F.transform(F.map_values(swapped), lambda v: -v))
    out = packages.withColumns({"_false": false, "_swapped": swapped, "margin": F.round(F.coalesce(F.try_element_at(best, F.lit(2)), F.lit(0.0)) - F.try_element_at(best, F.lit(1)), 6)})
    out = out.withColumns({"proposal": F.col("_false"), "probabilities": F.col("_swapped")})
    return out.withColumn("confidence", F.round(of(F.col("proposal")), 6)).drop("_false", "_swapped")


def reranked(candidates: Column) -> Column:
    """Candidates with ranks by place and anchors named ``P<rank>.<operation>``, the second of a kind with ``_2`` and so on."""

    def named(c: Column, rank: Column) -> Column:
        kinds = F.transform(c["anchors"], lambda a: F.coalesce(a["operation"], F.lit("evidence")))
        nth = lambda a, i: F.size(F.filter(F.slice(kinds, 1, i + 1), lambda k: k == F.coalesce(a["operation"], F.lit("evidence"))))
        name = lambda a, i: F.concat(F.lit("P"), rank.cast("string"), F.lit("."), F.coalesce(a["operation"], F.lit("evidence")), F.when(nth(a, i) > 1, F.concat(F.lit("_"), nth(a, i).cast("string"))).otherwise(F.lit("")))
        return c.withField("rank", rank).withField("anchors", F.transform(c["anchors"], lambda a, i: a.withField("anchor_id", name(a, i))))

    return F.transform(candidates, lambda c, i: named(c, (i + 1).cast("int")))


def foreign_first(packages: DataFrame, donors: DataFrame, seed: str, k: int = 10) -> DataFrame:
    """The donor case's best candidate under an opaque id in front (``case_id, donor_id``), ``k`` candidates at most, ranks and anchors renamed.

    Packages without a donor, or whose donor has no candidate, are left out, since nothing foreign can be put in.
    """
    best = packages.where(F.size("candidates") > 0).select(F.col("case_id").alias("donor_id"), F.element_at("candidates", 1).alias("_f"))
    joined = packages.join(donors.where("donor_id is not null").select("case_id", "donor_id"), "case_id").join(best, "donor_id")
    foreign = F.col("_f").withField("entity_id", S.opaque_id("F", F.lit(seed), F.col("case_id"), F.col("donor_id"), F.col("_f")["entity_id"]))
    combined = F.slice(F.concat(F.array(foreign), "candidates"), 1, k)
    return joined.withColumn("candidates", reranked(combined)).drop("_f")


def package_sizes(packages: DataFrame, records: DataFrame, accepted: DataFrame) -> DataFrame:
    """Bytes of all full cases, of their packages and of the accepted packages, with both ratios, as one row.

    ``records`` are the full cases, one row for each of a case's records; each is a line of JSON of
    all its columns but ``case_id``. ``accepted`` lists the accepted ``case_id``. Cases without
    records count zero bytes; ratios over nothing are null.
    """
    full = records.groupBy("case_id").agg(F.sum(F.octet_length(F.to_json(F.struct(*(c for c in records.columns if c != "case_id")))) + 1).alias("_full"))
    compact = payload(packages).select("case_id", (F.octet_length("payload") + 1).alias("_compact"))
    yes = accepted.select("case_id").distinct().withColumn("_yes", F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = compact.join(full, "case_id", "left").join(yes, "case_id", "left").agg(
        F.count("*").alias("cases_n"), F.count("_yes").alias("accepted_n"), total(F.col("_full")).alias("full_bytes"), total(F.col("_compact")).alias("compact_bytes"), total(F.when(F.col("_yes") == 1, F.col("_compact"))).alias("accepted_bytes"),
    )
    return sums.withColumns({"compact_share": F.round(F.try_divide("compact_bytes", "full_bytes"), 9), "accepted_share": F.round(F.try_divide("accepted_bytes", "compact_bytes"), 9)})


def payload(packages: DataFrame) -> DataFrame:
    """Canonical JSON text of a package, fields in alphabetical order."""
    c = F.transform("candidates", lambda c: F.struct(F.transform(c["anchors"], lambda a: F.struct(a["anchor_id"].alias("anchor_id"), a["operation"].alias("operation"))).alias("anchors"), c["entity_id"].alias("entity_id"), c["exe"].alias("exe"), c["rank"].alias("rank")))
    return packages.select("case_id", F.to_json(F.struct(c.alias("candidates"), "case_id")).alias("payload"))


def audit_packages(packages: DataFrame) -> DataFrame:
    """One row of counts: packages, repeated cases, broken rank sequences, repeated anchors."""
    ranks = F.transform("candidates", lambda c: c["rank"])
    anchors = F.flatten(F.transform("candidates", lambda c: F.transform(c["anchors"], lambda a: a["anchor_id"])))
    n = F.count("*").over(Window.partitionBy("case_id"))
    return packages.withColumn("_n", n).agg(
        F.count("*").alias("packages_n"), F.count_if(F.col("_n") > 1).alias("repeated_cases"),
        F.count_if(F.array_sort(ranks) != F.sequence(F.lit(1), F.size("candidates"))).alias("broken_ranks"), F.count_if(F.size(F.array_distinct(anchors)) < F.size(anchors)).alias("repeated_anchors"),
    )


def record_errors(records: DataFrame, required: list[str], statuses: list[str]) -> DataFrame:
    """A row for each fault of a case record: missing fields, unknown status, bad hash, repeated id."""
    counted = records.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    faults = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing:{c}")) for c in required]
    faults.append(F.when(~(F.col("status").isin(statuses) | F.col("status").startswith("FAILED_")), F.lit("unknown_status")))
    faults.append(F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit("bad_hash")))
    faults.append(F.when(F.col("_n") > 1, F.lit("repeated_id")))
    return counted.select("id", F.explode(F.array_compact(F.array(*faults))).alias("error"))
