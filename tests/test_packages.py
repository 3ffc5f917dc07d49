"""Package edits, planted audit faults and serialised sizes on small packages."""

import hashlib
import json

from pyspark.sql import functions as F
from spanlight.operators import packages as P

SCHEMA = "case_id string, candidates array<struct<rank:int,entity_id:string,exe:string,anchors:array<struct<anchor_id:string,operation:string>>>>, proposal string, probabilities map<string,double>, truth string"


def opaque(prefix, *parts):
    return prefix + "_" + hashlib.sha256("|".join(parts).encode()).hexdigest()[:20]


def cand(rank, name, *operations, exe="/bin/x"):
    return (rank, name, exe, [(f"{name}{i}", o) for i, o in enumerate(operations)])


def make(spark):
    p = {"collection": 0.1, "discovery": 0.6, "exfiltration": 0.1, "impact": 0.2}
    return spark.createDataFrame(
        [
            ("c1", [cand(1, "a", "open", "open", "load"), cand(2, "b", None)], "discovery", p, "collection"),
            ("c2", [cand(1, "z", "connect")], "impact", {"impact": 1.0}, "impact"),
            ("c3", [], None, {}, None),
            ("c4", None, "impact", None, None),
            ("c5", [cand(1, "y")], "discovery", p, None),
        ],
        SCHEMA,
    )


def by_case(df):
    return {r["case_id"]: r for r in df.collect()}


def names(row):
    return [(c["rank"], c["entity_id"], [a["anchor_id"] for a in c["anchors"]]) for c in row["candidates"]]


def test_renamed_ids_keep_everything_but_the_ids(spark):
    old, new = by_case(make(spark)), by_case(P.renamed_ids(make(spark), "7"))
    assert names(new["c1"]) == [(r, opaque("E", "7", "c1", "entity", e), [opaque("A", "7", "c1", "anchor", a) for a in anchors]) for r, e, anchors in names(old["c1"])]
    assert [[a["operation"] for a in c["anchors"]] for c in new["c1"]["candidates"]] == [["open", "open", "load"], [None]]
    assert new["c3"]["candidates"] == [] and new["c4"]["candidates"] is None


def test_diagnostic_anchors_and_programs_go(spark):
    new = by_case(P.without_anchors(make(spark), ["open", "connect"]))
    assert names(new["c1"]) == [(1, "a", ["a2"]), (2, "b", ["b0"])]
    assert names(new["c2"]) == [(1, "z", [])] and new["c2"]["candidates"][0]["exe"] == ""
    assert new["c4"]["candidates"] is None


def test_a_contradiction_takes_the_least_probable_wrong_class(spark):
    new = by_case(P.contradicted(make(spark)))
    # exfiltration and collection tie at 0.1, and collection is the truth; without a truth the smaller name wins.
    assert (new["c1"]["proposal"], new["c1"]["confidence"], new["c1"]["margin"]) == ("exfiltration", 0.6, 0.4)
    assert new["c1"]["probabilities"] == {"collection": 0.1, "discovery": 0.1, "exfiltration": 0.6, "impact": 0.2}
    assert new["c5"]["proposal"] == "collection"
    assert (new["c2"]["proposal"], new["c2"]["confidence"]) == ("impact", 1.0)
    assert new["c3"]["proposal"] is None and new["c4"]["proposal"] == "impact"
    top = by_case(P.with_confidence(make(spark)))
    assert (top["c1"]["proposal"], top["c1"]["confidence"], top["c1"]["margin"]) == ("discovery", 0.6, 0.4)
    assert (top["c2"]["margin"], top["c3"]["proposal"], top["c4"]["confidence"]) == (1.0, None, None)


def test_a_foreign_candidate_comes_first_and_anchors_are_named_anew(spark):
    donors = spark.createDataFrame([("c1", "c2"), ("c2", "c1"), ("c3", "c2"), ("c5", None)], "case_id string, donor_id string")
    new = by_case(P.foreign_first(make(spark), donors, "s", k=2))
    assert names(new["c1"]) == [(1, opaque("F", "s", "c1", "c2", "z"), ["P1.connect"]), (2, "a", ["P2.open", "P2.open_2", "P2.load"])]
    assert names(new["c2"]) == [(1, opaque("F", "s", "c2", "c1", "a"), ["P1.open", "P1.open_2", "P1.load"]), (2, "z", ["P2.connect"])]
    assert len(new["c3"]["candidates"]) == 1 and set(new) == {"c1", "c2", "c3"}
    named = by_case(make(spark).withColumn("candidates", P.reranked(F.col("candidates"))))
    assert names(named["c1"])[1] == (2, "b", ["P2.evidence"]) and named["c4"]["candidates"] is None
    assert P.foreign_first(make(spark).limit(0), donors, "s").count() == 0


def test_sizes_are_those_of_the_written_lines(spark):
    packages = make(spark).where("case_id in ('c1', 'c2')")
    records = spark.createDataFrame([("c1", 1, "é"), ("c1", 2, None), ("c9", 3, "x")], "case_id string, row_id int, name string")
    accepted = spark.createDataFrame([("c2",), ("c2",), ("c9",)], "case_id string")
    got = P.package_sizes(packages, records, accepted).first()
    full = len('{"row_id":1,"name":"é"}\n'.encode()) + len('{"row_id":2}\n')
    compact = {r["case_id"]: len(r["payload"].encode()) + 1 for r in P.payload(packages).collect()}
    assert all(json.loads(r["payload"]) for r in P.payload(packages).collect())
    assert (got["cases_n"], got["accepted_n"], got["full_bytes"], got["compact_bytes"], got["accepted_bytes"]) == (2, 1, full, sum(compact.values()), compact["c2"])
    assert got["compact_share"] == round(sum(compact.values()) / full, 9)
    none = P.package_sizes(packages.limit(0), records, accepted).first()
    assert (none["cases_n"], none["full_bytes"], none["compact_share"], none["accepted_share"]) == (0, 0, None, None)


def test_the_audit_sees_planted_faults(spark):
    packages = make(spark).where("case_id in ('c1', 'c2')")
    late = packages.where("case_id = 'c1'").withColumn("candidates", F.transform("candidates", lambda c: c.withField("rank", c["rank"] + 1)))
    twice = packages.where("case_id = 'c2'").withColumn("candidates", F.transform("candidates", lambda c: c.withField("anchors", F.concat(c["anchors"], c["anchors"]))))
    got = P.audit_packages(late.union(twice).union(twice)).first()
    assert (got["packages_n"], got["repeated_cases"], got["broken_ranks"], got["repeated_anchors"]) == (3, 2, 1, 2)
