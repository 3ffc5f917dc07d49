"""Queries over guards, profiles and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.plans import views as V
from spanlight.plans.registry import query
from spanlight.sources import io


@query(
    "s01_s02_flow_files",
    "SELECT protocol, count(*) AS n, round(sum(ts_s), 3) AS total_s, (SELECT count(*) FROM flow) AS rows_n, (SELECT count(*) FROM flow WHERE row_id % 97 = 0) AS malformed, (SELECT count(*) FROM flow WHERE row_id % 97 <> 0 AND row_id % 89 = 0) AS bad_time FROM flow WHERE row_id % 97 <> 0 AND row_id % 89 <> 0 GROUP BY 1",
)
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow view written as comma-separated files with faulty lines, and read again."""
    path = io.scratch_dir(spark)
    lines = V.flow(spark, sf_dir).select(
        F.concat_ws(",", F.when(F.col("row_id") % 89 == 0, F.lit("bad")).otherwise(F.col("ts_s").cast("decimal(20,6)").cast("string")), "src_ip", "protocol", F.when(F.col("row_id") % 97 == 0, F.lit("x,y")).otherwise(F.col("size").cast("string"))).alias("value")
    )
    lines.write.text(path)
    rows, counts = io.read_flow(spark, path, columns=["ts", "ip", "protocol", "size"])
    return rows.groupBy("protocol").agg(F.count("*").alias("n"), F.round(F.sum("ts_s"), 3).alias("total_s")).crossJoin(F.broadcast(counts))


@query(
    "s02_requoted_files",
    """, q AS (SELECT protocol, ts_s, CASE WHEN row_id % 7 = 0 THEN 'a, "b" ' || (row_id % 3) ELSE 'plain' END AS note, row_id % 97 = 0 AND row_id % 7 <> 0 AS torn FROM flow)
SELECT protocol, note, count(*) AS n, round(sum(ts_s), 3) AS total_s, (SELECT count(*) FROM q) AS rows_n, (SELECT count(*) FROM q WHERE torn) AS malformed, 0 AS bad_time FROM q WHERE NOT torn GROUP BY 1, 2""",
)
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow view with quoted notes that hold commas and quotes, which a plain split cannot read, and with torn lines."""
    path = io.scratch_dir(spark)
    note = F.when(F.col("row_id") % 7 == 0, F.concat(F.lit('"a, ""b"" '), (F.col("row_id") % 3).cast("string"), F.lit('"'))).when(F.col("row_id") % 97 == 0, F.lit("x,y")).otherwise(F.lit("plain"))
    V.flow(spark, sf_dir).select(F.concat_ws(",", F.col("ts_s").cast("decimal(20,6)").cast("string"), note, "protocol").alias("value")).write.text(path)
    rows, counts = io.read_flow(spark, path, requote=True, columns=["ts", "note", "protocol"])
    return rows.groupBy("protocol", "note").agg(F.count("*").alias("n"), F.round(F.sum("ts_s"), 3).alias("total_s")).crossJoin(F.broadcast(counts))


@query("s03_provenance_files", "SELECT type, count(*) AS n, count(DISTINCT exe) AS programs FROM prov_node GROUP BY 1")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance nodes written as quoted CSV with line breaks inside fields, and read again."""
    path = io.scratch_dir(spark)
    V.prov_node(spark, sf_dir).withColumn("note", F.concat(F.lit('a "b"\n'), "id")).write.csv(path, header=True, escape='"', quoteAll=True)
    back = io.read_provenance(spark, path).where(F.col("note") == F.concat(F.lit('a "b"\n'), "id"))
    return back.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("exe", F.lit(""))).alias("programs"))


@query("s05_json_lines", "SELECT fold, count(*) AS n, round(sum(score), 6) AS total FROM scored GROUP BY 1")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.scratch_dir(spark)
    io.write_jsonl(V.scored(spark, sf_dir).select("case_id", "fold", "score"), path, "fold")
    return io.read_jsonl(spark, path, "case_id bigint, score double, fold int").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("s04_nodes_and_edges", "SELECT 'node' AS part, type AS kind, count(*) AS n, count(DISTINCT id) AS ids FROM prov_node GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*), count(DISTINCT src) FROM prov_edge GROUP BY 2")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes twice over (an older copy first) and edges in one mixed table, as a provenance file has them."""
    n, e = V.prov_node(spark, sf_dir), V.prov_edge(spark, sf_dir)
    old = n.select("id", F.lit("Artifact").alias("type"), F.lit("").alias("time"), F.lit("").alias("src"), F.lit(0).cast("bigint").alias("ordinal"))
    new = n.select("id", "type", F.lit("").alias("time"), F.lit("").alias("src"), F.lit(1).cast("bigint").alias("ordinal"))
    edge = e.select(F.lit("").alias("id"), F.col("relation").alias("type"), F.col("ts_s").cast("string").alias("time"), "src", (F.col("row_id") + 2).alias("ordinal"))
    nodes, edges = io.split_provenance(old.union(new).union(edge))
    a = nodes.groupBy(F.lit("node").alias("part"), F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    return a.union(edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("ids")))


@query("s06_guards", "SELECT 0 AS missing_columns, count(*) AS rows_n, 0::BIGINT AS not_finite_size, 0::BIGINT AS null_keys, 0::BIGINT AS repeated_keys FROM flow")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.require(V.flow(spark, sf_dir), ["ts_s", "size"], "row_id", ["size"])


@query("s07_leaking_rows", "SELECT doc_id FROM documents WHERE contains(text, doc_id::VARCHAR)")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.leaking_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


@query(
    "s08_profile",
    "SELECT protocol, action, count(*) AS rows_n, sum(label)::BIGINT AS labelled, min(ts_s) AS first_s, max(ts_s) AS last_s, min(ts_s) FILTER (WHERE label = 1) AS first_labelled, strftime(make_timestamp((floor(min(ts_s)) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS first_utc FROM flow GROUP BY 1, 2",
)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.profile(V.flow(spark, sf_dir), "ts_s", ["protocol", "action"], "label")


@query("s09_overlap", "SELECT round(greatest(0, least(max(f.b), max(p.b)) - greatest(min(f.a), min(p.a))), 6) AS overlap_s, round(min(p.a) - min(f.a), 6) AS start_offset_s, round(max(p.b) - max(f.b), 6) AS end_offset_s FROM (SELECT min(ts_s) AS a, max(ts_s) AS b FROM flow) f, (SELECT min(ts_s) AS a, max(ts_s) AS b FROM prov_edge) p")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.overlap(V.flow(spark, sf_dir), V.prov_edge(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))
