"""Representations of cases under corruptions, and the models on them."""

import math
import os

import duckdb
from pyspark.sql import functions as F
from spanlight.operators import evidence as E
from spanlight.operators.models import corrupt
from spanlight.plans.all import ORACLE_SQL, QUERIES
from test_queries import rows


def processes(spark):
    listed = [("a", f"p{i}", 1 + i, i % 3, 10.0 * i, max(0.0, 1 - i / 6)) for i in range(7)] + [("b", "q0", 4, 0, 5.0, 0.5)] + [("c", f"r{i}", 2, 1, 0.0, 1.0) for i in range(4)]
    return listed, spark.createDataFrame(listed, "case_id string, id string, incident int, sockets int, closest double, proximity double")


def test_variants(spark):
    listed, df = processes(spark)
    donors = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "case_id string, donor_id string")
    found = {}
    for r in E.variants(df, donors).collect():
        found.setdefault((r.case_id, r.variant), {})[r.id] = r
    assert not any(v == "delete_process" for _, v in found)
    assert set(found["a", "replace_context"]) == {"q0"} and set(found["b", "replace_context"]) == {"r0", "r1", "r2", "r3"} and ("c", "replace_context") not in found
    assert all(r.sockets == 0 for r in found["a", "delete_socket"].values())
    assert all(r.proximity == 0 and r.closest == found["a", "clean"][i].closest + 600 for i, r in found["a", "shift_time"].items())
    assert set(found["b", "half_delete"]) == {"q0"}  # one row is always left
    score = {i: round(math.log1p(n) + p + math.log1p(s), 6) for c, i, n, s, _, p in listed if c == "a"}
    best = sorted(score, key=lambda i: (-score[i], i))[:3]
    assert set(found["a", "delete_top"]) == set(score) - set(best)
    assert len(found["a", "delete_random"]) == 4 and set(best) <= set(found["a", "delete_random"])
    assert len(found["c", "delete_top"]) == 2 and ("b", "delete_top") not in found


def test_summaries(spark):
    listed, df = processes(spark)
    found = {r.case_id: r for r in E.summaries(df.withColumn("variant", F.lit("clean")), 60.0).collect()}
    for case in "abc":
        mine = sorted(((round(math.log1p(n) + p + math.log1p(s), 6), i, p, s, n, t) for c, i, n, s, t, p in listed if c == case), key=lambda r: (-r[0], r[1]))
        total = sum(r[0] for r in mine)
        top = mine[:3]
        r = found[case]
        assert r.n == len(mine) and math.isclose(r.top_rank_score, mine[0][0]) and math.isclose(r.rank_score_margin, mine[0][0] - (mine[1][0] if len(mine) > 1 else 0), abs_tol=1e-12)
        assert math.isclose(r.rank_score_entropy, -sum(m[0] / total * math.log(m[0] / total) for m in mine) / max(math.log(len(mine)), 1), abs_tol=1e-12)
        assert math.isclose(r.top3_score_mass, sum(m[0] for m in top) / total) and math.isclose(r.top3_time_proximity, sum(m[2] for m in top) / len(top), abs_tol=1e-12)
        moved = sorted(mine, key=lambda m: (-round(math.log1p(m[4]) + max(0, 1 - (m[5] + 30) / 60) + math.log1p(m[3]), 6), m[1]))[:3]
        both = len({m[1] for m in top} & {m[1] for m in moved})
        assert math.isclose(r.top3_stability_30s, both / (2 * len(top) - both))


def test_replaced_context_without_donors(spark):
    df = spark.createDataFrame([("a", "p", 1, 2.0, 3, 4.0)], "case_id string, id string, rank int, score double, sockets int, delta double")
    assert {r.family for r in corrupt(df, ["shift_time", "replace_context"]).collect()} == {"shift_time"}


def test_agreement_level(spark):
    p = {"x": [0.6, 0.4, 0.0], "y": [0.5, 0.5, 0.0], "z": [0.1, 0.2, 0.7], "w": [0.2, 0.8, 0.0]}
    df = spark.createDataFrame([tuple(p.values())], ", ".join(f"{k} array<double>" for k in p))
    level = lambda *v: E.agreement_level([F.col(c) for c in v])
    assert tuple(df.select(level("x", "y", "x"), level("x", "y", "z"), level("x", "w", "z")).first()) == (2, 1, 0)


def test_deletion_lift_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{os.path.join(folder, 'events.parquet')}'")
    got = QUERIES["m12_deletion_lift"](spark, folder).toPandas()
    assert len(got) and rows(got) == rows(con.sql(ORACLE_SQL["m12_deletion_lift"]).df())
    assert (got.top_drop != 0).any()


def test_feature_modes():
    names = list(E.pair_features(["a", "b"]))
    assert len(names) == 10 + 4 * 2 + 6 + 8 + 48
    kept = {m: set(E.mode_features(names, m)) for m in E.PAIR_MODES}
    assert kept["full"] == set(names)
    assert "affinity" not in kept["without_network_posterior"] and "network_p_a" not in kept["without_network_posterior"] and "posterior_product_b" not in kept["without_network_posterior"]
    assert {"network_s_tcp", "provenance_p_a", "cross_tcp_top_rank_score"} <= kept["without_network_posterior"]
    assert kept["network_only"] == {n for n in names if n.startswith("network_")} and not kept["network_only"] & kept["provenance_only"]


def test_brier_score(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3], 2), ([1.0, 0.0, 0.0], 1), ([1.0, 0.0, 0.0], 3)], "p array<double>, t int")
    assert [round(r.b, 9) for r in df.select(E.brier_score(F.col("p"), F.col("t")).alias("b")).collect()] == [0.38, 0.0, 2.0]
