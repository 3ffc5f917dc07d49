"""Running sums by ranges against plain Python, with continuous scores and a key that holds most rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from spanlight.operators import metrics as M
from spanlight.operators import prefix as P


def table(n=3000):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.8 else rng.choice("abc"), rng.random(), rng.randrange(2), i) for i in range(n)]
    return rows + [("hot", 0.5, 1, n + i) for i in range(200)]  # ties


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(table(), "k string, score double, y int, id int").repartition(4)


def test_running_sums(spark, df):
    found = P.running(df, ["k"], [F.desc("score"), F.asc("id")], {"upto": F.col("y"), "place": F.lit(1).cast("bigint")}, block=250)
    assert found.columns == ["k", "score", "y", "id", "upto", "place"]
    got = {r.id: (r.upto, r.place) for r in found.collect()}
    groups = defaultdict(list)
    for k, score, y, i in table():
        groups[k].append((-score, i, y))
    for rows in groups.values():
        total = 0
        for place, (_, i, y) in enumerate(sorted(rows), 1):
            total += y
            assert got.pop(i) == (total, place)
    assert not got


def test_no_task_holds_a_key(spark, df):
    """80 % of the rows have one key; ranges stay near the wanted size, so no task of the ordered pass sees the whole key."""
    dealt = df.repartitionByRange(-(-df.count() // 250), "k", F.desc("score"), F.asc("id")).withColumn("b", F.spark_partition_id())
    sizes = Counter(r.b for r in dealt.collect())
    assert max(sizes.values()) < 600 and len(sizes) > 8
    plan = P.running(df, ["k"], [F.desc("score")], {"n": F.lit(1)}, block=250)._jdf.queryExecution().toString()
    windows = [line for line in plan.split("Physical Plan")[1].splitlines() if "Window [" in line]
    assert any("_block" in w.split("specifiedwindowframe")[0] or "_block" in w for w in windows)


def test_global_order_and_empty(spark, df):
    found = P.numbered(df, [], [F.asc("id")], "n", block=400).collect()
    assert all(r.n == r.id + 1 for r in found)
    assert P.numbered(df.limit(0), ["k"], [F.asc("id")], "n").count() == 0


@pytest.mark.parametrize("n", [1, 4, 7, 5000])
def test_tiles(spark, df, n):
    from pyspark.sql import Window

    a = {r.id: r.t for r in P.tiles(df, ["k"], [F.asc("id")], n, "t", block=300).collect()}
    b = {r.id: r.t for r in df.withColumn("t", F.ntile(n).over(Window.partitionBy("k").orderBy("id"))).collect()}
    assert a == b


def test_metrics_alike_in_many_ranges(spark, df, monkeypatch):
    """Thresholds, areas, coverage, curves and percentiles do not depend on how many ranges there are."""
    s = df.where("k is not null").withColumns({"case_id": F.col("id"), "correct": F.col("y")})

    def everything():
        k = ["k"]
        parts = [M.select_threshold(s, k, 0.1, 500), M.curve_areas(s, k), M.fixed_coverage(s, k, 0.37).select("k", "case_id"), M.kth_thresholds(s, k, 0.7), M.kth_score(s, k, 20), M.risk_curve(s, k).select("case_id", "rank", "errors"), M.mid_percentile(s.select("case_id", "k", "score"), s.where("y = 0"), k).select("case_id", "percentile")]
        return [sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in p.collect()) for p in parts]

    whole = everything()
    monkeypatch.setattr(P, "BLOCK", 200)
    assert everything() == whole
