"""Neighbours: sparse queries, repeated rows, fill-up, recall and the scored share at two sizes."""

import numpy as np
import pytest
from spanlight.llm import ann


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")


def lists(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def brute(x, i, k):
    s = x @ x[i]
    s[i] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist()


def test_few_queries_against_many_files(spark):
    x = np.random.default_rng(1).standard_normal((3000, 8))
    df = frame(spark, x)
    got = lists(ann.neighbours(df, df.where("vec_id in (5, 77)")))
    assert set(got) == {5, 77} and all(len(v) == 20 for v in got.values())
    assert len(set(got[5]) & set(brute(x, 5, 20))) >= 16
    assert ann.neighbours(df, df.where("vec_id < 0")).count() == 0


def test_repeated_rows_count_once(spark):
    x = np.random.default_rng(2).standard_normal((300, 8))
    df = frame(spark, x)
    once, twice = lists(ann.neighbours(df, df.where("vec_id % 50 = 0"))), lists(ann.neighbours(df.union(df), df.union(df).where("vec_id % 50 = 0")))
    assert once == twice and once[50] == brute(x, 50, 20)


def test_files_that_hold_too_few_are_filled_up(spark):
    x = np.random.default_rng(3).standard_normal((2000, 4))
    x[7] = [-50.0, 0.1, 0.1, 0.1]
    x[:, 0] = np.abs(x[:, 0]) + 5
    x[7, 0] = -50
    df = frame(spark, x)
    got = lists(ann.neighbours(df, df.where("vec_id = 7"), k=1500))
    assert got[7] == brute(x, 7, 1500)


def test_block_sides_may_be_empty():
    import pyarrow as pa

    t = pa.table({"id": pa.array([1], pa.int64()), "v": pa.array([np.ones(4).tobytes()], pa.binary()), "orders": pa.array([np.arange(1, dtype=np.int16).tobytes()], pa.binary())})
    assert ann.search_block(t, t.slice(0, 0), 0, 5, 0.5, 4, 1).num_rows == ann.search_block(t.slice(0, 0), t, 0, 5, 0.5, 4, 1).num_rows == 0


def test_pivots_grow_and_the_share_falls():
    sizes = [10_000, 100_000, 10_000_000, 10**9]
    assert [ann.pivots_for(n) for n in sizes] == [128, 512, 4096, 8192]
    shares = [ann.share_for(ann.pivots_for(n)) for n in sizes]
    assert shares == sorted(shares, reverse=True) and shares[0] < 0.25


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select("vec_id", "embedding")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = lists(ann.neighbours(df, df.where("vec_id % 20 = 0")))
    hits = [len(set(got[i]) & {int(ids[j]) for j in brute(x, k, 20)}) for k, i in enumerate(ids.tolist()) if i % 20 == 0]
    assert np.mean(hits) / 20 >= 0.9
