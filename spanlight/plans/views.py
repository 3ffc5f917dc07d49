"""Flow, provenance, score and decision views over the ``events`` table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions.scalars import NETWORK_TACTICS, PROVENANCE_TACTICS, canonical_tactic

WINDOW, GAP, EMBARGO, RADIUS = 3600, 7200, 1800, 1800
TOLERANCES, OFFSETS = (30, 60, 120, 300), (-3600, -1800, 0, 1800, 3600)
PORTS = (53, 80, 443, 502, 1883, 1900, 8883, 8888)
CONDITIONS = ("clean", "delete_process", "delete_socket", "shift_time", "half_delete", "replace_context")
_PROTOCOLS = {"click": "TCP", "view": "UDP", "purchase": "ICMP", "signup": "ARP"}
_RELATIONS = {"click": "Used", "view": "WasGeneratedBy", "purchase": "WasTriggeredBy"}
_OPERATIONS = ("load", "execve", "open", "update", "unlink", "rename2", "chmod", "setuid", "mmap")
_EXES = ("/usr/bin/python3", "/bin/bash", "/home/u/tool", "/tmp/run.sh", "/usr/sbin/sshd", "curl")
_SUBTYPES = ("file", "directory", "link", "network socket")
_FILES = ("/tmp/f", "/home/u/f", "/etc/f", "/var/f", "/usr/lib/f")


def _case(column: str, names: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{other}' END"


def _pick(index: str, names: tuple) -> str:
    values = [f"'{x}'" if isinstance(x, str) else str(x) for x in names]
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _dst_port(k: str) -> str:
    return f"CASE WHEN {k} % 13 = 0 THEN 50000 + {k} ELSE {_pick(f'{k} % 8', PORTS)} END"


_TAC8 = "(h // 17 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 8"
_NET, _PROV = tuple(NETWORK_TACTICS), tuple(PROVENANCE_TACTICS)[:8]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with epoch seconds, the number ``k``, the hour ``h`` and the tactic number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.expr("unix_micros(cast(ts as timestamp)) / 1e6")
    e = e.select("event_id", "user_id", "event_type", "value", seconds.alias("ts_s"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("h", F.floor(F.col("ts_s") / 3600))
    return e.withColumn("tac8", F.expr(_TAC8.replace("h // 17", "(h div 17)")))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir)
    out = e.selectExpr(
        "event_id AS row_id", "ts_s", "concat('10.0.0.', user_id % 7) AS src_ip", "concat('10.0.1.', k % 5) AS dst_ip", "1024 + user_id AS src_port",
        f"cast({_dst_port('k')} as bigint) AS dst_port", f"{_case('event_type', _PROTOCOLS, 'other')} AS protocol", "value AS size", "k % 2 AS flag",
        "cast(event_type = 'error' and h % 17 < 2 as int) AS label", f"{_pick('tac8', _NET)} AS raw_tactic", "concat('a', k % 3) AS action",
    )
    return out.withColumn("tactic", canonical_tactic(F.col("raw_tactic"), NETWORK_TACTICS))


def prov_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir)
    users = e.select("user_id").distinct().selectExpr(
        "concat('p', user_id) AS id", "'Process' AS type", "'' AS subtype", "cast(1000 + user_id as string) AS pid", f"{_pick('user_id % 6', _EXES)} AS exe",
        "'' AS path", "cast(null as string) AS remote_ip", "cast(null as bigint) AS remote_port", "cast(user_id % 11 = 0 as int) AS label",
        "repeat('n', cast(1 + user_id % 9 as int)) AS name", "CASE WHEN user_id % 3 = 0 THEN '' ELSE cast(999 + user_id as string) END AS parent_pid",
    )
    things = e.select("k").distinct().selectExpr(
        "concat('a', k) AS id", "'Artifact' AS type", f"{_pick('k % 4', _SUBTYPES)} AS subtype", "'' AS pid", "'' AS exe",
        f"{_pick('k % 5', _FILES)} AS path", "concat('10.0.1.', k % 5) AS remote_ip", f"cast({_dst_port('k')} as bigint) AS remote_port", "0 AS label", "'' AS name", "'' AS parent_pid",
    )
    return users.unionByName(things)


def prov_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir).where("event_id % 3 <> 0")
    out = e.selectExpr(
        "event_id AS row_id", "ts_s + (event_id % 7 - 3) * 40.0D AS ts_s",
        "CASE WHEN k % 4 = 3 THEN concat('a', k) ELSE concat('p', user_id) END AS src", "CASE WHEN k % 4 = 3 THEN concat('p', user_id) ELSE concat('a', k) END AS dst",
        f"CASE WHEN k % 4 = 3 THEN 'WasGeneratedBy' ELSE {_case('event_type', _RELATIONS, 'WasDerivedFrom')} END AS relation",
        f"CASE WHEN k % 4 = 3 THEN 'connect' ELSE {_pick('k % 9', _OPERATIONS)} END AS operation",
        "cast(event_type = 'error' and user_id % 3 <> 0 and h % 17 < 2 and (h div 17) % 5 <> 0 as int) AS label", f"{_pick('tac8', _PROV)} AS raw_tactic",
    )
    return out.withColumn("tactic", canonical_tactic(F.col("raw_tactic"), PROVENANCE_TACTICS))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).selectExpr(
        "event_id AS case_id", "cast(1 + event_id % 3 as int) AS fold", "cast(1 + (event_id div 3) % 2 as int) AS seed", "CASE user_id % 2 WHEN 0 THEN 'logistic' ELSE 'trees' END AS model",
        "floor(value / 5 + 0.5) / 100 AS score", "cast(event_type = 'error' as int) AS y", "k % 5 AS tactic", "cast((k + user_id) % 5 as int) AS prediction", "user_id AS group_id", "h",
    )


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cases under the clean condition and five corruptions, with a decision from a hash."""
    condition = F.explode(F.array(*map(F.lit, CONDITIONS))).alias("condition")
    d = scored(spark, sf_dir).select("*", condition)
    number = "cast(conv(substring(md5(concat_ws('|', case_id, condition, '{}')), 1, 8), 16, 10) as bigint) % 100"
    return d.selectExpr("*", f"cast({number.format('accepted')} < CASE condition WHEN 'clean' THEN 70 ELSE 45 END as int) AS accepted", f"cast({number.format('correct')} < CASE condition WHEN 'clean' THEN 75 ELSE 50 END as int) AS correct")


def _tactic_sql(raw: str, names: dict[str, str]) -> str:
    return f"CASE {raw} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE 'unmapped:' || {raw} END"


VIEWS_SQL = f"""base AS (SELECT *, {_TAC8} AS tac8 FROM (SELECT *, floor(ts_s / 3600)::BIGINT AS h FROM (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS ts_s, json_extract_string(props, '$.k')::INT AS k FROM events))),
flow AS (SELECT *, {_tactic_sql('raw_tactic', NETWORK_TACTICS)} AS tactic FROM (SELECT event_id AS row_id, ts_s, '10.0.0.' || (user_id % 7) AS src_ip, '10.0.1.' || (k % 5) AS dst_ip, 1024 + user_id AS src_port,
  ({_dst_port('k')})::BIGINT AS dst_port, {_case('event_type', _PROTOCOLS, 'other')} AS protocol, value AS size, k % 2 AS flag,
  (event_type = 'error' AND h % 17 < 2)::INT AS label, {_pick('tac8', _NET)} AS raw_tactic, 'a' || (k % 3) AS action FROM base)),
prov_node AS (SELECT DISTINCT 'p' || user_id AS id, 'Process' AS type, '' AS subtype, (1000 + user_id)::VARCHAR AS pid, {_pick('user_id % 6', _EXES)} AS exe, '' AS path,
    NULL::VARCHAR AS remote_ip, NULL::BIGINT AS remote_port, (user_id % 11 = 0)::INT AS label, repeat('n', (1 + user_id % 9)::INT) AS name, CASE WHEN user_id % 3 = 0 THEN '' ELSE (999 + user_id)::VARCHAR END AS parent_pid FROM base
  UNION ALL SELECT DISTINCT 'a' || k, 'Artifact', {_pick('k % 4', _SUBTYPES)}, '', '', {_pick('k % 5', _FILES)}, '10.0.1.' || (k % 5), ({_dst_port('k')})::BIGINT, 0, '', '' FROM base),
prov_edge AS (SELECT *, {_tactic_sql('raw_tactic', PROVENANCE_TACTICS)} AS tactic FROM (SELECT event_id AS row_id, ts_s + (event_id % 7 - 3) * 40.0::DOUBLE AS ts_s,
  CASE WHEN k % 4 = 3 THEN 'a' || k ELSE 'p' || user_id END AS src, CASE WHEN k % 4 = 3 THEN 'p' || user_id ELSE 'a' || k END AS dst,
  CASE WHEN k % 4 = 3 THEN 'WasGeneratedBy' ELSE {_case('event_type', _RELATIONS, 'WasDerivedFrom')} END AS relation,
  CASE WHEN k % 4 = 3 THEN 'connect' ELSE {_pick('k % 9', _OPERATIONS)} END AS operation,
  (event_type = 'error' AND user_id % 3 <> 0 AND h % 17 < 2 AND (h // 17) % 5 <> 0)::INT AS label, {_pick('tac8', _PROV)} AS raw_tactic FROM base WHERE event_id % 3 <> 0)),
obs AS (SELECT ts_s, tactic, 'network' AS view, action AS detail, '' AS type, '' AS pid FROM flow WHERE label = 1
  UNION ALL SELECT ts_s, tactic, 'provenance', operation, relation, CASE WHEN src LIKE 'p%' THEN (1000 + substr(src, 2)::BIGINT)::VARCHAR ELSE '' END FROM prov_edge WHERE label = 1),
steps AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER (PARTITION BY tactic ORDER BY ts_s) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM obs),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY tactic ORDER BY ts_s RANGE UNBOUNDED PRECEDING)::BIGINT AS n FROM steps),
cases AS (SELECT tactic || '_' || lpad(n::VARCHAR, 4, '0') AS case_id, tactic, min(ts_s) AS start_s, max(ts_s) AS end_s, count(*) AS rows_n,
  count(*) FILTER (WHERE view = 'network') AS network_n, count(*) FILTER (WHERE view = 'provenance') AS provenance_n,
  min(ts_s) FILTER (WHERE view = 'network') AS network_start, max(ts_s) FILTER (WHERE view = 'network') AS network_end,
  min(ts_s) FILTER (WHERE view = 'provenance') AS provenance_start, max(ts_s) FILTER (WHERE view = 'provenance') AS provenance_end FROM numbered GROUP BY tactic, n),
anchored AS (SELECT *, coalesce(network_start, start_s) AS anchor FROM cases),
scored AS (SELECT event_id AS case_id, (1 + event_id % 3)::INT AS fold, (1 + (event_id // 3) % 2)::INT AS seed, CASE user_id % 2 WHEN 0 THEN 'logistic' ELSE 'trees' END AS model,
  floor(value / 5 + 0.5) / 100 AS score, (event_type = 'error')::INT AS y, k % 5 AS tactic, ((k + user_id) % 5)::INT AS prediction, user_id AS group_id, h FROM base),
decision AS (SELECT *, (('0x' || substr(md5(concat_ws('|', case_id, condition, 'accepted')), 1, 8))::BIGINT % 100 < CASE condition WHEN 'clean' THEN 70 ELSE 45 END)::INT AS accepted,
  (('0x' || substr(md5(concat_ws('|', case_id, condition, 'correct')), 1, 8))::BIGINT % 100 < CASE condition WHEN 'clean' THEN 75 ELSE 50 END)::INT AS correct
  FROM scored, (SELECT unnest({list(CONDITIONS)}) AS condition))"""
