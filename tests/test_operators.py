"""Operators on hand-made fixtures and against plain Python."""

import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from spanlight.functions import scalars as S
from spanlight.operators import joins as J
from spanlight.operators import metrics as M
from spanlight.operators import models as L
from spanlight.operators import packages as P
from spanlight.operators import resample as B
from spanlight.operators import splits as D
from spanlight.operators import windows as W
from spanlight.sources import io


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values[0]) if isinstance(values[0], tuple) else 1)]
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(column(*(F.col(n) for n in names))).collect()]


def test_ports_and_pids(spark):
    values = ["0", "80", "70000", "http", "", None, " 443 ", "53.0", "-1", "nan"]
    assert one(spark, S.window_port, *values) == ["0", "80", "", "", "", "", "443", "53", "", ""]
    assert one(spark, S.graph_port, *values) == ["", "80", "70000", "http", "", "", "443", "53", "-1", "nan"]
    assert one(spark, S.join_port, *values) == [None, 80, None, None, None, None, 443, 53, None, None]
    assert one(spark, S.normal_pid, "4133.0", "x", None, "") == ["4133", "x", "", ""]


def test_addresses(spark):
    values = ["10.0.0.1", "127.0.0.1", "0.0.0.0", "256.1.1.1", "::1", "::", "fe80::1", "2001:db8:0:0:0:0:0:1", "a:b", "", None, "1:2:3:4:5:6:7:8"]
    assert one(spark, S.usable_ip, *values) == [True, False, False, False, False, False, True, True, False, False, False, True]


def test_first_timestamp_and_flags(spark):
    assert one(spark, S.first_timestamp, ("", "nan", "3.5"), ("x", "2", "1"), (None, "inf", None)) == [3.5, 2.0, None]
    assert one(spark, S.truthy, "Yes", " 1", "TRUE", "no", None) == [True, True, True, False, False]


def test_text(spark):
    payload = "echo aGVsbG8gMTAuMC4wLjE= | base64 -d"
    assert one(spark, S.normal_text, f"RUN  {payload} T1059.001 42") == ["run echo agvsbg8gmtaumc4wlje= | base64 -d <technique> <num> hello <ip>"]
    assert one(spark, lambda c: S.compact_text(c, 6), " a  b ", "abcdefgh", None) == ["a b", "abcde…", ""]
    assert one(spark, S.path_depth, "/usr/bin/x", "x", "", None) == [3, 0, 0, 0]


def test_window_profile_and_spine(spark):
    rows = spark.createDataFrame([(125.0, 100.0), (65.0, 5.0), (121.0, 50.0), (301.0, float("nan"))], "ts_s double, size double")
    got = {r.window_start: r for r in W.dense(W.window_profile(rows, 60, ["size"], [], {}), 60).collect()}
    assert sorted(got) == [60, 120, 180, 240, 300]
    assert got[120].row_count == 2 and got[120].size_mean == 75 and got[120].size_std == 25 and got[180].row_count == 0
    assert got[300].row_count == 1 and got[300].size_mean == 0 and got[300].size_max == 0


@pytest.mark.parametrize("block", [50.0, 700.0, 1e9])
def test_gap_clusters_by_blocks(spark, block):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), float(rng.randint(0, 4000))) for _ in range(150)] + [("a", 10.0), ("a", 10.0), ("c", 1.0)]
    want = {}
    for key in "abc":
        n, last = 0, None
        for t in sorted(t for k, t in rows if k == key):
            n += last is None or t - last > 30
            last = t
            want[key, t] = n
    got = W.gap_clusters(spark.createDataFrame(rows, "k string, ts double"), ["k"], "ts", 30, block).collect()
    assert len(got) == len(rows) and all(want[r.k, r.ts] == r.cluster_n for r in got)


def test_an_equal_step_stays(spark):
    df = spark.createDataFrame([("t", 0.0), ("t", 300.0), ("t", 600.1)], "k string, ts double")
    assert [r.cluster_n for r in W.gap_clusters(df, ["k"], "ts", 300).orderBy("ts").collect()] == [1, 1, 2]


def test_merged_intervals_and_points(spark):
    i = spark.createDataFrame([(1, 5.0, 7.0), (1, 1.0, 3.0), (1, 3.0, 4.0), (1, 8.0, 9.0)], "k int, a double, b double")
    m = W.merge_intervals(i, ["k"], "a", "b")
    assert sorted((r.a, r.b) for r in m.collect()) == [(1, 4), (5, 7), (8, 9)]
    p = spark.createDataFrame([(1, t) for t in (0.9, 1.0, 4.0, 4.5, 7.0, 9.1)] + [(2, 1.0)], "k int, t double")
    assert sorted(r.t for r in W.points_inside(p, m, ["k"], "t", "a", "b", 2).collect()) == [1.0, 4.0, 7.0]


def test_range_join_has_closed_ends(spark):
    c = spark.createDataFrame([(1, 100.0)], "id int, c double")
    e = spark.createDataFrame([(t,) for t in (69.9, 70.0, 100.0, 130.0, 130.1)], "t double")
    assert sorted(r.t for r in J.within(c, e, "c", "t", 30).collect()) == [70, 100, 130]


def test_nearest_distance(spark):
    rows = [("x", 0.0, "a"), ("x", 10.0, "b"), ("x", 14.0, "a"), ("y", 5.0, "a")]
    got = J.nearest_distance(spark.createDataFrame(rows, "k string, t double, s string"), "k", "t", "s", "a", "b").collect()
    assert sorted((r.t, r.distance) for r in got) == [(0, 10), (10, 4), (14, 4)]


@pytest.mark.parametrize("block", [7.0, 90.0, 1e9])
def test_blocks_of_time_change_nothing(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), float(rng.randint(0, 900)), rng.choice("ab")) for _ in range(120)] + [("z", 3.0, "a")]
    df = spark.createDataFrame(rows, "k string, t double, s string")
    got = J.nearest_distance(df, "k", "t", "s", "a", "b", block)
    assert got.columns == ["k", "t", "s", "distance"]
    want = []
    for k, t, s in rows:
        others = [abs(t - u) for j, u, v in rows if j == k and v != s]
        want += [(k, t, s, min(others))] if others else []
    assert sorted(map(tuple, got.collect())) == sorted(want)
    swept = {(r.k, r.gap): r.clusters for r in W.gap_sweep(df, "k", "t", (5, 20), block).collect()}
    for gap in (5, 20):
        each = {}
        for k in "xyz":
            times = sorted(t for j, t, _ in rows if j == k)
            each[k] = 1 + sum(v - u > gap for u, v in zip(times, times[1:], strict=False))
            assert swept[k, gap] == each[k]
        assert swept["all", gap] == sum(each.values())


def test_two_hops(spark):
    e = spark.createDataFrame([(1, "s", "a"), (1, "a", "b"), (1, "b", "c"), (2, "s", "z")], "case_id int, u string, v string")
    s = spark.createDataFrame([(1, "s")], "case_id int, id string")
    assert {(r.id, r.hop) for r in J.two_hops(e, s).collect()} == {("s", 0), ("a", 1), ("b", 2)}


def test_donors_are_others(spark):
    rows = [(i, i % 2, i % 3) for i in range(40)] + [(99, 5, 0)]
    got = {r.id: r.donor_id for r in J.hashed_donor(spark.createDataFrame(rows, "id int, block int, key int"), "block", "id", "key", "s").collect()}
    by = {i: (b, k) for i, b, k in rows}
    assert got[99] is None and len(got) == 41
    assert all(by[d][0] == by[i][0] and by[d][1] != by[i][1] for i, d in got.items() if d is not None)


def test_ranks_and_ties(spark):
    rows = [("c", "a", 0.9, 0), ("c", "b", 0.8, 1), ("c", "c", 0.8, 0)]
    df = spark.createDataFrame(rows, "case string, id string, score double, y int")
    t = M.tie_bounds(df).first()
    assert (t.optimistic, t.pessimistic, t.mid_rank, t.tied) == (2, 3, 2.5, 2)
    b = M.best_ranks(df).first()
    assert (b.best_rank, b.reciprocal, b.hit_1, b.hit_5, b.top_id) == (2, 0.5, 0, 1, "a")
    none = M.best_ranks(df.withColumn("y", F.lit(0))).first()
    assert none.reciprocal == 0 and none.normalised is None


def test_expected_reciprocal(spark):
    df = spark.createDataFrame([(3, 1, 0), (4, 2, 1), (3, 0, 0)], "n bigint, t bigint, b bigint")
    got = [r[0] for r in df.select(M.expected_reciprocal(F.col("n"), F.col("t"), F.col("b"))).collect()]
    assert got[0] == pytest.approx((1 + 1 / 2 + 1 / 3) / 3) and got[2] == 0
    ways = [1 / 2] * 3 + [1 / 3] * 2 + [1 / 4]
    assert got[1] == pytest.approx(sum(ways) / 6)


def test_threshold_and_areas(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 1), (0.4, 0)]
    df = spark.createDataFrame([(1, s, y) for s, y in rows], "fold int, score double, y int")
    t = M.select_threshold(df, ["fold"], 1, 1).first()
    assert (t.threshold, t.true_alerts, t.false_alerts) == (0.5, 3, 1)
    assert M.select_threshold(df.where("y = 0"), ["fold"], 0, 1).first().threshold == math.inf
    a = M.curve_areas(df, ["fold"]).first()
    assert a.ap == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4) and a.auc == pytest.approx((2.5 - 1 + 3) / 6 + 0.0, abs=0.01)
    assert M.curve_areas(df.where("y = 1"), ["fold"]).first().ap is None


def test_coverage_rounds_half_to_even(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "case_id int, score double").withColumn("g", F.lit(1))
    assert M.fixed_coverage(df, ["g"], 0.5).count() == 2
    assert M.fixed_coverage(df, ["g"], 0.0).count() == 1


def test_coverage_with_ties_and_null_scores(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0.1, 0.1, 0.5, 0.9]), i % 3) for i in range(70)]
    df = spark.createDataFrame(rows, "case_id int, score double, g int")
    for share in (0.0, 0.33, 0.5, 0.97, 1.0):
        want = []
        for g in range(3):
            ordered = sorted((r for r in rows if r[2] == g), key=lambda r: (-(r[1] if r[1] is not None else -1), r[0]))
            want += ordered[: max(1, round(share * len(ordered)))]
        got = M.fixed_coverage(df, ["g"], share)
        assert got.columns == df.columns and sorted(r.case_id for r in got.collect()) == sorted(r[0] for r in want)
    k = {r.g: (r.threshold, r.rows_n) for r in M.kth_score(df.where("score is not null"), ["g"], 12).collect()}
    for g in range(3):
        scores = sorted((r[1] for r in rows if r[2] == g and r[1] is not None), reverse=True)
        assert k[g] == (scores[11] if len(scores) > 11 else None, len(scores))


def test_outcomes_of_nothing_accepted(spark):
    df = spark.createDataFrame([("m", 0, 1), ("m", 0, 0)], "model string, accepted int, correct int")
    r = M.outcomes(df, ["model"]).first()
    assert (r.accepted_n, r.risk, r.wrong_rate, r.rejection) == (0, None, 0, 1)


def test_groups_never_cross_folds(spark):
    rows = [(f"c{i}", float(i * 1000), float(i * 1000 + 100), "x" if i % 3 else "y", "c") for i in range(30)]
    g = D.embargo_groups(spark.createDataFrame(rows, "case_id string, start_s double, end_s double, tactic string, campaign string"), ["campaign"], 450)
    assert g.select("group_n").distinct().count() == 1
    g = D.embargo_groups(g.drop("group_n"), ["campaign"], 449).cache()
    assert g.select("group_n").distinct().count() == 30
    folds = D.stratified_folds(g.groupBy("campaign", "group_n", "tactic").agg(F.count("*").alias("n")), "campaign").collect()
    assert len(folds) == 30 and {r.fold for r in folds} == {1, 2, 3}
    sizes = [sum(r.fold == f for r in folds) for f in (1, 2, 3)]
    assert max(sizes) - min(sizes) <= 2


def test_bootstrap_repeats(spark):
    df = spark.createDataFrame([(i, i % 3, 2) for i in range(20)], "u int, a int, b int")
    x, y = (tuple(B.bootstrap_ratio(df, "u", "a", "b", 30, "s").first()) for _ in range(2))
    assert x == y and x[1] <= x[0] <= x[2]
    w = B.drawn_weights(df.select("u"), "u", 5, "s").groupBy("replicate").agg(F.sum("w").alias("w")).collect()
    assert {r.w for r in w} == {20}


def test_exact_tests(spark):
    df = spark.createDataFrame([(1, 5), (0, 0), (3, 3)], "a bigint, b bigint")
    got = [r[0] for r in df.select(B.mcnemar_p(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([2 * (1 + 6) / 64, 1.0, 1.0])
    d = spark.createDataFrame([(1,), (1,), (1,), (-1,), (0,)], "d int")
    assert B.sign_flip(d).first().p == pytest.approx(2 * (1 + 4) / 16)


def test_model_scores(spark):
    rows = [(i, float(i % 2) + random.Random(i).random(), float(i % 7), i % 2, i % 3) for i in range(90)]
    df = L.balanced_weights(spark.createDataFrame(rows, "id int, x double, z double, y int, fold int"), "y")
    out = L.out_of_fold(df, ["x", "z"], "y", "fold", ("logistic", "trees", "mlp"))
    got = out.select("id", "model", "y", F.element_at("probabilities", 2).alias("p")).collect()
    assert len(got) == 270 and all(0 <= r.p <= 1 for r in got)
    for m in ("logistic", "trees", "mlp"):
        assert sum((r.p > 0.5) == (r.y == 1) for r in got if r.model == m) > 70


def test_model_scores_after_an_observation(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.max("id").alias("most")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"most": 4}
    rows = [(i, float(i % 2) + random.Random(i).random(), i % 2, i % 3) for i in range(30)]
    df = L.balanced_weights(spark.createDataFrame(rows, "id int, x double, y int, fold int"), "y")
    assert L.out_of_fold(df, ["x"], "y", "fold").count() == len(L.out_of_fold(df, ["x"], "y", "fold").collect()) == 30


def test_entropy_terms(spark):
    df = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0])], "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    e, m, j, a = df.select(L.entropy(p), L.margin(q), L.js_divergence(p, q), L.affinity(p, q)).first()
    assert e == pytest.approx(math.log(2)) and m == 1 and a == pytest.approx(math.sqrt(0.5)) and 0.2 < j < 0.22


PACKAGE = ("k1", [(1, "e1", "x", [("a1", "open")]), (2, "e2", "y", [("a2", "load")])], 2, "discovery")
VALID = '{"schema_version":"3.0","case_id":"k1","tactic":"discovery","evidence_sufficient":true,"integrity_alarm":false,"confidence":0.5,"support_process_ref":"P1","cited_anchor_ids":["a1"],"reason_codes":["ambiguous_tactic"]}'


def test_certificates(spark):
    packages = spark.createDataFrame([PACKAGE], "case_id string, candidates array<struct<rank:int,entity_id:string,exe:string,anchors:array<struct<anchor_id:string,operation:string>>>>, candidate_count bigint, proposal string")
    cases = {
        VALID: [],
        VALID.replace('"a1"', '"zz"'): ["hallucinated_anchor_id"],
        VALID.replace('"a1"', '"a2"'): ["anchor_owner_not_cited"],
        VALID.replace("discovery", "collection"): ["tactic_differs_from_machine_proposal"],
        VALID.replace('"P1"', '"P7"'): ["attribute_without_observed_anchor", "anchor_owner_not_cited", "hallucinated_entity_id", "hallucinated_process_ref"],
        VALID.replace(":true", ":1"): ["attribute_without_sufficiency", "invalid_evidence_sufficient"],
        VALID.replace('"confidence":0.5,', ""): ["invalid_confidence_type", "missing_keys:confidence"],
        VALID.replace('"discovery"', "null"): ["abstain_marked_sufficient", "abstain_with_support_citation"],
        "not json": ["missing_response"],
    }
    df = spark.createDataFrame([("k1", c) for c in cases], "case_id string, response string")
    for r in P.check_certificates(df, packages).collect():
        assert sorted(r.errors) == sorted(cases[r.response]), r.response
        assert r.valid == (not cases[r.response]) and r.decision == ("attribute" if r.valid else "abstain")


def test_first_json(spark):
    df = spark.createDataFrame([('say {x {"a": {"b": 1}} more',), ('{"a": 1}',), ("none",), (None,)], "t string")
    got = [tuple(r.j) for r in df.select(P.first_json(F.col("t")).alias("j")).collect()]
    assert got == [('{"a": {"b": 1}}', True), ('{"a": 1}', False), (None, False), (None, False)]


def test_flow_reader(spark, tmp_path):
    path = tmp_path / "flow.csv"
    path.write_text('ts,ip,n\n1.5,a,1\nbad,b,2\n2,c\n3,"x,y",4\n\n4,d,5\n')
    rows, counts = io.read_flow(spark, str(path))
    assert sorted(r.ts_s for r in rows.collect()) == [1.5, 4.0] and tuple(counts.first()) == (5, 2, 1)
    rows, counts = io.read_flow(spark, str(path), requote=True)
    assert ("x,y", 3.0) in {(r.ip, r.ts_s) for r in rows.collect()} and counts.first().malformed == 1


def test_provenance_reader(spark, tmp_path):
    path = tmp_path / "prov.csv"
    path.write_text('﻿id,type,time,command\nn1,Process,,"a ""b""\nline"\nn1,Process,5,last\n,Used,7,edge\n,Used,,untimed\n')
    rows = io.read_provenance(spark, str(path))
    nodes, edges = io.split_provenance(rows)
    assert [(r.id, r.command) for r in nodes.collect()] == [("n1", "last")] and [r.ts_s for r in edges.collect()] == [7.0]


def test_json_lines_and_guards(spark, tmp_path):
    df = spark.createDataFrame([("case-1", {"x": 1}, "see case-1"), ("case-2", {"x": 2}, "ok")], "id string, m map<string,int>, note string")
    io.write_jsonl(df, str(tmp_path / "out"))
    assert io.read_jsonl(spark, str(tmp_path / "out"), df.schema).orderBy("id").collect() == df.orderBy("id").collect()
    assert [r.id for r in io.leaking_rows(df, "id").collect()] == ["case-1"]
    nested = spark.sql("select 1 as ok, struct(2 as raw_label, array(struct(3 as Tactic_x)) as rows) as s")
    assert io.forbidden_fields(nested) == ["s.raw_label", "s.rows.Tactic_x"]
    bad = spark.createDataFrame([(1, 1.0), (1, float("nan")), (None, None)], "k int, v double")
    r = io.require(bad, ["k", "gone"], "k", ["v"]).first()
    assert (r.missing_columns, r.not_finite_v, r.null_keys, r.repeated_keys) == (1, 2, 1, 1)
    assert tuple(io.overlap(spark.createDataFrame([(0.0,), (10.0,)], "ts_s double"), spark.createDataFrame([(5.0,), (12.0,)], "ts_s double")).first()) == (5, 5, 2)


def test_disjoint_centres(spark):
    rows = [("a", float(t)) for t in range(0, 1000, 5)]
    got = sorted(r.centre for r in J.disjoint_centres(spark.createDataFrame(rows, "k string, t double"), "k", "t", 5, 40, 1, 100).collect())
    assert len(got) == 5 and all(b - a >= 80 for a, b in zip(got, got[1:], strict=False))
    assert J.disjoint_centres(spark.createDataFrame(rows, "k string, t double"), "k", "t", 5, 40, 1, 2).count() == 0


def test_nearest_flow_without_pairs(spark):
    rng = random.Random(5)
    flows = [(i, rng.randrange(0, 400) / 2, rng.choice("ab"), rng.choice("ab"), rng.choice([1, 2]), rng.choice([1, 2])) for i in range(150)]
    socks = [(i, rng.randrange(0, 400) / 2, rng.choice("ab"), rng.choice([1, 2])) for i in range(60)]
    flow = spark.createDataFrame(flows, "row_id int, ts_s double, src_ip string, dst_ip string, src_port int, dst_port int")
    sockets = spark.createDataFrame(socks, "socket_id int, ts_s double, remote_ip string, remote_port int")
    out = J.nearest_flow(sockets, flow, (-20, 0, 20), 3)
    want = {}
    for s, t, ip, port in socks:
        for o in (-20, 0, 20):
            near = [(abs(u - t - o), r, e, l) for r, u, a, b, p, q in flows for e, (i, n, l) in enumerate(((a, p, b), (b, q, a))) if (i, n) == (ip, port) and abs(u - t - o) <= 3]
            if near:
                want[s, o] = min(near)
    assert {(r.socket_id, r.offset): (r.delta, r.row_id, r.side, r.local_ip) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
