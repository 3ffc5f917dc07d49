"""Nearest donors by tiles and the triangle inequality against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from spanlight.operators import joins as J


def brute(rows):
    out = set()
    for b, i, v, l in rows:
        for same in (True, False):
            found = [(round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9), j) for c, j, w, m in rows if c == b and j != i and (m == l) == same]
            if found:
                out.add((i, same, *reversed(min(found))))
    return out


def table(kind, n=220):
    rng = random.Random(8)
    centres = [[rng.uniform(-50, 50) for _ in range(4)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.5) for x in c] if kind == "clustered" else [round(rng.gauss(0, 1), 1) for _ in range(4)] if kind == "random" else c
        rows.append((rng.choice("ab") if kind != "clustered" else "a", i, v, rng.randrange(3)))
    return rows


@pytest.mark.parametrize(("kind", "tile"), [("clustered", 12), ("random", 20), ("copies", 4), ("random", 10_000)])
def test_all_pairs(spark, kind, tile):
    rows = table(kind)
    df = spark.createDataFrame(rows, "b string, i bigint, v array<double>, l int").repartition(3)
    got = {(r.i, r.same, r.donor_id, r.distance) for r in J.nearest_donors(df, "b", "i", "v", "l", tile).collect()}
    assert got == brute(rows)


def test_tiles_are_ruled_out(spark):
    df = spark.createDataFrame(table("clustered", 600), "b string, i bigint, v array<double>, l int")
    assert J.tile_share(df, "b", "i", "v", "l", 20) < 0.3


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0], 0)], "b string, i bigint, v array<double>, l int")
    assert J.nearest_donors(df, "b", "i", "v", "l").count() == 0
    assert J.nearest_donors(df.limit(0), "b", "i", "v", "l").count() == 0


def test_vectors_are_sent_once_a_group(spark):
    """Random vectors rule little out; what is sent must not grow with the number of tiles."""
    df = spark.createDataFrame(table("random", 600), "b string, i bigint, v array<double>, l int")
    _, tiled, radius = J._tiled(df, "b", "i", "v", "l", 10)
    near = J._own_tile(tiled)
    grouped, wanted = J._wanted_groups(tiled, near, radius, 10)
    groups = grouped.select("_block", "_g").distinct().count()
    assert groups <= 6 and wanted.count() <= tiled.count() * groups < J._wanted_tiles(tiled, near, radius).count()


def test_neither_rows_nor_sends_grow_with_tiles(spark):
    """Of many tiles, a row keeps one bit each, and a vector is sent to a bounded number of groups."""
    rows = [("a", *r[1:]) for r in table("random", 3000)]
    _, tiled, radius = J._tiled(spark.createDataFrame(rows, "b string, i bigint, v array<double>, l int"), "b", "i", "v", "l", 10)
    grouped, wanted = J._wanted_groups(tiled, J._own_tile(tiled), radius, 10)
    assert max(len(v) for r in grouped.collect() for v in r if isinstance(v, list)) <= 10  # 300 bits in words of 32
    assert grouped.select("_g").distinct().count() <= J.GROUPS + 1 and wanted.count() <= tiled.count() * (J.GROUPS + 1)


@pytest.mark.parametrize("kind", ["random", "ties", "far", "tiny", "one"])
@pytest.mark.parametrize("classes", [1, 3, 90])
def test_compare_is_exact(monkeypatch, kind, classes):
    """Products of single precision only choose what is worked out: no place, scale or tie of the data may show."""
    monkeypatch.setattr(J, "ROWS", 16)
    rng = np.random.default_rng(3)
    v = {"random": rng.normal(size=(160, 5)), "ties": rng.integers(0, 3, (160, 5)) * 1.0, "far": 1e6 + rng.normal(size=(160, 5)) * 1e-3, "tiny": rng.normal(size=(160, 5)) * 1e-30, "one": np.ones((160, 5))}[kind]
    every = pd.DataFrame({"_block": "a", "_key": [str(i) for i in range(160)], "l": [str(x) for x in rng.integers(0, classes, 160)], "donor": rng.permutation(160), "_v": list(v)})
    a, b = every[:100], every[60:]
    got = J._compare(a, b).merge(a[["_key", "donor"]], on="_key", suffixes=("", "_of"))
    want = set()
    for i, x, m in zip(a["donor"], a["_v"], a["l"]):
        for same in (True, False):
            found = [(float(np.round(np.sqrt(((y - x) ** 2).sum()), 9)), j) for j, y, k in zip(b["donor"], b["_v"], b["l"]) if j != i and (m == k) == same]
            want |= {(i, same, *min(found))} if found else set()
    assert set(zip(got["donor_of"], got["same"], got["distance"], got["donor"])) == want
