"""Clock offsets over re-run relations, and donors merged into graphs."""

import math

from pyspark.sql import functions as F
from spanlight.operators import graph as G
from spanlight.operators import joins as J


def test_offsets_from_one_join(spark):
    cases = spark.createDataFrame([("a", 1000.0), ("b", 5000.0)], "case_id string, anchor double")
    edges = spark.createDataFrame([(i, 137.0 * i) for i in range(60)], "row_id int, ts_s double")
    offsets = [-900.0, -30.0, 0.0, 600.0]
    got = {(r.offset_s, r.case_id, r.row_id, round(r.delta, 6)) for r in G.offset_relations(cases, edges, 400, offsets).collect()}
    assert got == {(o, c, i, round(137.0 * i - (t - o), 6)) for o in offsets for c, t in (("a", 1000.0), ("b", 5000.0)) for i in range(60) if abs(137.0 * i - (t - o)) <= 400}
    plain = {(r.case_id, r.row_id) for r in G.case_relations(cases, edges, 400).collect()}
    assert {g[1:3] for g in got if g[0] == 0.0} == plain


def test_drift_moves_the_support(spark):
    nodes = spark.createDataFrame([("p1", "Process", 1), ("p2", "Process", 0), ("x", "Artifact", 0)], "id string, type string, label int")
    edges = spark.createDataFrame([(100.0, "p1", "x"), (101.0, "p1", "x"), (1000.0, "p2", "x")], "ts_s double, src string, dst string")
    cases = spark.createDataFrame([("c", 100.0), ("empty", 90000.0)], "case_id string, anchor double")
    rel = G.offset_relations(cases, edges, 50, [0.0, -900.0])
    got = {(r.offset_s, r.case_id): r for r in G.drift(rel, nodes, cases, [0.0, -900.0], 50, 0.1).collect()}
    assert got[0.0, "c"].kept and got[0.0, "c"].primary and got[0.0, "c"].correct == 1
    assert not got[-900.0, "c"].kept and not got[-900.0, "c"].primary and got[-900.0, "c"].gate and got[-900.0, "c"].correct == 0
    assert math.isclose(got[0.0, "c"].margin, round(math.log1p(2) + 1, 6)) and not got[0.0, "empty"].gate and len(got) == 4


def test_merged_graphs(spark):
    ent = spark.createDataFrame([("a", "process"), ("a", "file"), ("b", "process")], "case_id string, kind string")
    rel = spark.createDataFrame([("a", "Used", "open"), ("b", "Used", "load")], "case_id string, relation string, operation string")
    d_ent = spark.createDataFrame([(1, "process"), (1, "process"), (1, "socket"), (2, "file")], "donor_id int, kind string")
    d_rel = spark.createDataFrame([(1, "Used", "open"), (1, "WasTriggeredBy", "connect"), (2, "Used", "open")], "donor_id int, relation string, operation string")
    pairs = spark.createDataFrame([("a", "busy", 1), ("b", "busy", 2)], "case_id string, band string, donor_id int")
    got = {r.case_id: tuple(r)[2:] for r in G.merged_graphs(pairs, ent, rel, d_ent, d_rel).collect()}
    assert got["a"] == (5, 3, 2, "file=1,process=3,socket=1", "Used=2,WasTriggeredBy=1", "connect=1,open=2")
    assert got["b"] == (2, 2, 0, "file=1,process=1", "Used=2", "load=1,open=1")


def test_banded_donors(spark):
    donors = spark.createDataFrame([(i, "low" if i < 5 else "high") for i in range(7)], "donor_id int, band string")
    cases = spark.createDataFrame([(f"c{i}",) for i in range(30)], "case_id string")
    got = J.banded_donors(cases, donors).collect()
    assert len(got) == 60 and all((r.donor_id < 5) == (r.band == "low") for r in got)
    assert len({r.donor_id for r in got}) == 7
    assert {(r.case_id, r.band): r.donor_id for r in got} == {(r.case_id, r.band): r.donor_id for r in J.banded_donors(cases.orderBy(F.desc("case_id")), donors).collect()}
