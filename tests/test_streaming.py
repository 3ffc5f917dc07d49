"""Streams over a folder of files give what the batch forms give."""

from pyspark.sql import functions as F
from spanlight.operators import windows as W
from spanlight.streaming.windows import streamed_clusters, streamed_profile


def drain(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_profile_and_clusters(spark, tmp_path):
    rows = [(float(t), "ab"[i % 2], float(i), i % 2) for i, t in enumerate([5, 20, 61, 65, 130, 135, 400, 700, 701, 990, 5000])]
    batch = spark.createDataFrame(rows, "ts_s double, tactic string, size double, label int")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = {r.window_start: (r.row_count, r.size_sum) for r in drain(spark, streamed_profile(stream, 60, 30), "profile", tmp_path / "p").collect()}
    want = {r.window_start: (r.row_count, r.size_sum) for r in W.window_profile(batch, 60, ["size"], [], {}).collect()}
    assert {k: v for k, v in want.items() if k < 4900} == got
    clusters = sorted((r.tactic, r.start_s, r.end_s, r.rows_n) for r in drain(spark, streamed_clusters(stream, 300, 30), "clusters", tmp_path / "s").collect())
    closed = W.gap_clusters(batch, ["tactic"], "ts_s", 300).groupBy("tactic", "cluster_n").agg(F.min("ts_s").alias("a"), F.max("ts_s").alias("b"), F.count("*").alias("n")).where("b < 4600")
    assert clusters == sorted((r.tactic, r.a, r.b, r.n) for r in closed.collect())
