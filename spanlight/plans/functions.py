"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions import scalars as S
from spanlight.plans import views as V
from spanlight.plans.registry import query

# Text columns as a raw file would have them, made from the events.
_RAW = """raw AS (SELECT event_id, k, user_id, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'x' ELSE (k * 10)::VARCHAR END AS time_text, CASE k % 3 WHEN 0 THEN 'inf' ELSE (k + 0.5)::VARCHAR END AS seen_text, (1000 + k)::VARCHAR AS start_text,
  CASE user_id % 5 WHEN 0 THEN user_id || '.0' WHEN 1 THEN '' WHEN 2 THEN 'pid' || user_id WHEN 3 THEN ' ' || user_id ELSE user_id::VARCHAR END AS pid_text,
  CASE k % 6 WHEN 0 THEN '0' WHEN 1 THEN '70000' WHEN 2 THEN 'http' WHEN 3 THEN '-1' WHEN 4 THEN k || '.0' ELSE (50000 + k)::VARCHAR END AS port_text,
  CASE k % 6 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '0.0.0.0' WHEN 2 THEN '300.1.1.1' WHEN 3 THEN '' ELSE '10.0.' || k || '.' || user_id % 250 END AS ip_text, CASE k % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' ELSE '' END AS flag_text FROM base)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.base(spark, sf_dir).selectExpr(
        "event_id", "k", "user_id", "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'x' ELSE cast(k * 10 as string) END AS time_text", "CASE k % 3 WHEN 0 THEN 'inf' ELSE cast(k + 0.5 as string) END AS seen_text", "cast(1000 + k as string) AS start_text",
        "CASE user_id % 5 WHEN 0 THEN concat(user_id, '.0') WHEN 1 THEN '' WHEN 2 THEN concat('pid', user_id) WHEN 3 THEN concat(' ', user_id) ELSE cast(user_id as string) END AS pid_text",
        "CASE k % 6 WHEN 0 THEN '0' WHEN 1 THEN '70000' WHEN 2 THEN 'http' WHEN 3 THEN '-1' WHEN 4 THEN concat(k, '.0') ELSE cast(50000 + k as string) END AS port_text",
        "CASE k % 6 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '0.0.0.0' WHEN 2 THEN '300.1.1.1' WHEN 3 THEN '' ELSE concat('10.0.', k, '.', user_id % 250) END AS ip_text", "CASE k % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' ELSE '' END AS flag_text",
    )


@query("f01_first_timestamp", f", {_RAW} SELECT k, coalesce(CASE WHEN isfinite(try_cast(time_text AS DOUBLE)) THEN try_cast(time_text AS DOUBLE) END, CASE WHEN isfinite(try_cast(seen_text AS DOUBLE)) THEN try_cast(seen_text AS DOUBLE) END, try_cast(start_text AS DOUBLE)) AS ts_s, count(*) AS n FROM raw GROUP BY 1, 2")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = S.first_timestamp(F.col("time_text"), F.col("seen_text"), F.col("start_text"))
    return raw(spark, sf_dir).groupBy("k", ts.alias("ts_s")).agg(F.count("*").alias("n"))


@query("f02_pids", f", {_RAW} SELECT user_id, coalesce(try_cast(try_cast(trim(pid_text) AS DOUBLE) AS BIGINT)::VARCHAR, trim(pid_text)) AS pid, count(*) AS n FROM raw GROUP BY 1, 2")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).groupBy("user_id", S.normal_pid(F.col("pid_text")).alias("pid")).agg(F.count("*").alias("n"))


_P = "try_cast(try_cast(port_text AS DOUBLE) AS BIGINT)"


@query(
    "f03_f05_ports",
    f", {_RAW} SELECT k, CASE WHEN {_P} BETWEEN 0 AND 65535 THEN {_P}::VARCHAR ELSE '' END AS window_port, CASE WHEN {_P} IS NULL THEN port_text WHEN {_P} = 0 THEN '' ELSE {_P}::VARCHAR END AS graph_port, CASE WHEN {_P} BETWEEN 1 AND 65535 THEN {_P}::INT END AS join_port, count(*) AS n FROM raw GROUP BY ALL",
)
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("port_text")
    return raw(spark, sf_dir).groupBy("k", S.window_port(p).alias("window_port"), S.graph_port(p).alias("graph_port"), S.join_port(p).alias("join_port")).agg(F.count("*").alias("n"))


@query(
    "f06_f07_addresses_and_flags",
    f""", {_RAW} SELECT ip_text, (regexp_full_match(ip_text, '[0-9]+(\\.[0-9]+){{3}}') AND list_max(list_transform(string_split(ip_text, '.'), lambda x: coalesce(try_cast(x AS INT), 999))) <= 255 AND ip_text NOT LIKE '127.%' AND ip_text <> '0.0.0.0')::INT AS usable,
  (lower(trim(flag_text)) IN ('1', 'true', 'yes'))::INT AS flag, count(*) AS n FROM raw GROUP BY ALL""",
)
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).groupBy("ip_text", S.usable_ip(F.col("ip_text")).cast("int").alias("usable"), S.truthy(F.col("flag_text")).cast("int").alias("flag")).agg(F.count("*").alias("n"))


@query(
    "f10_stable_bucket",
    "SELECT user_id, (('0x' || substr(sha256('u' || user_id), 1, 16))::UBIGINT % 97)::BIGINT AS bucket, 's_' || substr(sha256(user_id::VARCHAR), 1, 20) AS id, count(*) AS n FROM base GROUP BY 1",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    return V.base(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", S.stable_bucket(F.concat(F.lit("u"), u), 97).alias("bucket"), S.opaque_id("s", u).alias("id"), "n")


@query(
    "f11_f12_kinds_and_groups",
    """SELECT CASE WHEN n.type = 'Process' THEN 'process' WHEN n.subtype = 'network socket' THEN 'socket' WHEN n.subtype IN ('file', 'directory', 'link') THEN n.subtype ELSE 'artifact' END AS kind,
  CASE WHEN operation IN ('load', 'execve', 'connect', 'unlink') THEN operation WHEN operation LIKE 'rename%' THEN 'rename' WHEN operation IN ('setuid', 'setgid', 'chmod') THEN 'privilege' WHEN operation IN ('open', 'update') THEN 'open_update' ELSE 'other' END AS grp, count(*) AS n FROM prov_edge e JOIN prov_node n ON n.id = e.dst GROUP BY 1, 2""",
)
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = V.prov_node(spark, sf_dir).select(F.col("id").alias("dst"), S.entity_kind(F.col("type"), F.col("subtype")).alias("kind"))
    return V.prov_edge(spark, sf_dir).join(nodes, "dst").groupBy("kind", S.operation_group(F.col("operation")).alias("grp")).agg(F.count("*").alias("n"))


@query(
    "f13_path_features",
    """SELECT id, lower(list_extract(string_split(exe, '/'), -1)) AS base, greatest(0, len(list_filter(string_split(exe, '/'), lambda x: x <> '')) - CASE WHEN exe LIKE '/%' THEN 0 ELSE 1 END)::INT AS depth, (exe LIKE '/bin/%' OR exe LIKE '/usr/%')::INT AS is_system_binary, (exe LIKE '/home/%' OR exe LIKE '/tmp/%')::INT AS is_user_binary,
  (exe = '/bin/bash')::INT AS utility_shell, (exe = 'curl')::INT AS utility_network FROM prov_node WHERE type = 'Process'""",
)
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.path_features(F.col("exe"), F.lit(""))
    return V.prov_node(spark, sf_dir).where("type = 'Process'").select("id", *(f[c].alias(c) for c in ("base", "depth", "is_system_binary", "is_user_binary", "utility_shell", "utility_network")))


@query(
    "f14_normal_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(?:\d{1,3}\.){3}\d{1,3}\b', ' <ip> ', 'g'), '\bt\d{4}(?:\.\d{3})?\b', ' <technique> ', 'g'), '\b\d+\b', ' <num> ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""",
)
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(S.normal_text(F.col("text"))).alias("digest"))


@query(
    "f15_compact_text",
    r"""SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 79)) || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
)
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.compact_text(F.col("text"), 80).alias("short"))


_CMD = "cmd AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'sudo ip addr add 192.168.' || k || '.' || (user_id % 250) || '/24 dev eth0' WHEN 1 THEN 'ip link set up' ELSE '' END AS c FROM base)"


@query("f16_configured_addresses", f", {_CMD} SELECT regexp_extract(c, 'ip\\s+addr(?:ess)?\\s+add\\s+(\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}})', 1) AS address, count(*) AS n, min(event_id) AS first_event FROM cmd WHERE c LIKE '%addr%' GROUP BY 1")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.base(spark, sf_dir).selectExpr("event_id", "CASE k % 3 WHEN 0 THEN concat('sudo ip addr add 192.168.', k, '.', user_id % 250, '/24 dev eth0') WHEN 1 THEN 'ip link set up' ELSE '' END AS c")
    return c.select("event_id", S.configured_ip(F.col("c")).alias("address")).where("address is not null").groupBy("address").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("f17_size_bins", "SELECT CASE WHEN n <= 20 THEN '<=20' WHEN n <= 100 THEN '21-100' ELSE '>100' END AS bin, count(*) AS users, sum(n)::BIGINT AS rows_n FROM (SELECT user_id, count(*) AS n FROM base GROUP BY 1) GROUP BY 1")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.base(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.groupBy(S.size_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("users"), F.sum("n").alias("rows_n"))


@query(
    "f18_reason_codes",
    "SELECT condition, CASE WHEN condition = 'delete_process' THEN 'missing_process_evidence' WHEN h % 17 >= 14 THEN 'temporal_mismatch' WHEN tactic <> prediction THEN 'conflicting_cross_view_evidence' WHEN score < 0.2 THEN 'ambiguous_tactic' ELSE 'sufficient_observed_support' END AS reason, count(*) AS n FROM decision GROUP BY 1, 2",
)
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    processes = F.when(F.col("condition") == "delete_process", 0).otherwise(1)
    reason = S.reason_code(processes, F.col("h") % 17 < 14, F.col("tactic") == F.col("prediction"), F.col("score"))
    return V.decision(spark, sf_dir).groupBy("condition", reason.alias("reason")).agg(F.count("*").alias("n"))
