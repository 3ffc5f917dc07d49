"""Sweeps of packing over few, no and equal lengths."""

import pytest
from spanlight.llm import packing


def placed(spark, counts, capacity):
    """The pieces of each sequence as (offset, length), from the flows of the sweeps."""
    got = {}
    rows = spark.createDataFrame(counts, "length bigint, n bigint")
    for f in packing.sweeps(rows, capacity).collect():
        for j in range(f["n"]):
            got.setdefault(f["sequence"] + j // f["per"], []).append((f["at"] + j % f["per"] * f["length"], f["length"]))
    return got


@pytest.mark.parametrize(
    "counts, capacity, fewest",
    [([], 64, 0), ([(64, 3)], 64, 3), ([(1, 200)], 64, 4), ([(33, 2), (31, 2)], 64, 2), ([(40, 3), (24, 2), (20, 1), (3, 5)], 64, 4)],
)
def test_every_piece_has_one_place_without_gaps(spark, counts, capacity, fewest):
    got = placed(spark, counts, capacity)
    assert sorted(n for pieces in got.values() for _, n in pieces) == sorted(n for n, k in counts for _ in range(k))
    for pieces in got.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(got) == fewest


def test_sweeps_are_planned_once_and_the_setting_comes_back(spark, monkeypatch):
    key, seen, sweep = "spark.sql.adaptive.enabled", [], packing.sweep
    before = spark.conf.get(key)

    def watched(*args):
        seen.append(spark.conf.get(key))
        return sweep(*args)

    monkeypatch.setattr(packing, "sweep", watched)
    counts = spark.createDataFrame([(5, 3), (7, 2)], "length bigint, n bigint")
    assert sum(r.n for r in packing.sweeps(counts, 10).collect()) == 5
    assert seen and set(seen) == {"false"} and spark.conf.get(key) == before
    monkeypatch.setattr(packing, "sweep", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        packing.sweeps(counts, 10)
    assert spark.conf.get(key) == before


def test_a_sweep_is_one_write_without_joins_and_its_flows_are_one_scan(spark, monkeypatch):
    plans, swept, materialize, sweep = [], [], packing.materialize, packing.sweep
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(df):
        plans.append(plan(df))
        return materialize(df)

    monkeypatch.setattr(packing, "materialize", watched)
    monkeypatch.setattr(packing, "sweep", lambda *args: swept.append(sweep(*args)) or swept[-1])
    counts = spark.createDataFrame([(n, 1 + n % 3) for n in range(1, 300)], "length bigint, n bigint")
    flows = packing.sweeps(counts, 400)
    assert sum(r.n for r in flows.collect()) == sum(1 + n % 3 for n in range(1, 300))
    # One table for the counts, one for each sweep.
    assert len(swept) > 2 and len(plans) == 1 + len(swept)
    assert not any(word in p for p in plans[1:] for word in ("Join", "BroadcastExchange"))
    assert plan(flows).count("FileScan") == 1
