"""Intervals over as many replicates as are asked for by default, and the laws that their draws follow."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from spanlight.operators import resample as B
from spanlight.plans import splits
from spanlight.plans.all import QUERIES

DATA = "/root/testdata/sf0.001"


def test_reselected_risk_has_all_replicates(spark):
    assert splits.R == 10_000
    got = QUERIES["b04_reselected_risk"](spark, DATA).collect()
    assert {r.replicate for r in got} == set(range(10_000)) and all(0 <= r.risk <= 1 for r in got)


def test_draws_are_multinomial(spark, monkeypatch):
    """Every replicate draws as many as there are units; a unit's draws have the mean and the variance of a binomial."""
    monkeypatch.setattr(B, "DRAWS", 8)  # a replicate's draws come from several rows
    n, r = 37, 4000
    units = spark.range(n).select((F.col("id") * 10).alias("u"))
    w = B.drawn_weights(units, "u", r, "s")
    assert {x[0] for x in w.groupBy("replicate").agg(F.sum("w")).select("sum(w)").collect()} == {n}
    per = {x.unit: (x.s / r, x.q / r) for x in w.groupBy("unit").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).collect()}
    assert set(per) == {10 * i for i in range(n)}
    for mean, square in per.values():
        assert mean == pytest.approx(1, abs=5 / math.sqrt(r)) and square - mean**2 == pytest.approx(1 - 1 / n, abs=0.15)
    monkeypatch.setattr(B, "DRAWS", 1 << 16)
    whole = Counter({(x.replicate, x.unit): x.w for x in B.drawn_weights(units, "u", 50, "s").collect()})
    assert whole == Counter({(x.replicate, x.unit): x.w for x in w.where("replicate < 50").collect()})


@pytest.mark.parametrize("parts", [1, 5, 256])
def test_reselection_against_copied_rows(spark, parts):
    rows = [(i, round((i * 37 % 11) / 11, 3), i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "u int, score double, bad boolean").withColumn("bad", F.col("bad").cast("int"))
    drawn = {}
    for x in B.drawn_weights(df.select("u"), "u", 30, "t").collect():
        drawn.setdefault(x.replicate, {})[x.unit] = x.w
    got = {x.replicate: x.risk for x in B.top_share_risk(df, "u", "score", "bad", 0.3, 30, "t", parts).collect()}
    for b, w in drawn.items():
        copies = sorted(((-s, u, bad) for u, s, bad in rows for _ in range(w.get(u, 0))))
        keep = max(1, round(len(copies) * 0.3))
        assert got[b] == pytest.approx(sum(c[2] for c in copies[:keep]) / keep)


@pytest.mark.parametrize("draws", [16, 1 << 22])
def test_packed_draws_are_small_and_those_of_the_hash(spark, monkeypatch, draws):
    monkeypatch.setattr(B, "DRAWS", draws)  # few draws of many places are kept as places
    n, r = 203, 3
    want = Counter((b, int(hashlib.md5(f"s|{b}|{d // 4}".encode()).hexdigest()[8 * (d % 4) :][:8], 16) % n) for b in range(r) for d in range(n))
    got = Counter()
    rows = B._draws(spark, n, r, "s").collect()
    for x in rows:
        got.update({(x.replicate, i): int(w) for i, w in enumerate(B._unpacked(x.kind, x.data, n)) if w})
    assert got == want
    assert sum(len(x.data) for x in rows) <= (n + 1) // 2 * r if draws > n else {x.kind for x in rows} == {1}
