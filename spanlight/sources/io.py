"""Readers, writers, guards and profiles of flow and provenance tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from spanlight.functions.scalars import finite

# Parts of a name that tell the truth, an identity or absolute time; no feature may carry them.
FORBIDDEN = ("label", "tactic", "cluster", "incident", "attack", "malicious", "timestamp", "epoch", "iat", "idle_time")


def read_flow(spark: SparkSession, path: str, ts: str = "ts", requote: bool = False, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable rows of a comma-separated flow file as text columns plus ``ts_s``, and one row of counts.

    Rows with another number of fields than the header, or without a finite time, are dropped but
    counted. With ``requote``, rows that a plain split cannot read are parsed as quoted CSV. The
    first line names the columns unless ``columns`` does, as many files without a header need.
    """
    header = None if columns else spark.read.text(path).first()
    names = columns or ([c.strip() for c in header.value.lstrip("﻿").split(",")] if header else [])
    if ts not in names:
        raise ValueError(f"no column {ts}")
    lines = spark.read.text(path).where(F.ltrim("value", F.lit("﻿")) != ",".join(names)).where(F.length("value") > 0)
    parts = F.split("value", ",", -1)
    good = F.size(parts) == len(names)
    if requote:
        schema = ", ".join(f"`{n}` string" for n in names)
        quoted = F.from_csv("value", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
        again = F.array(*(F.coalesce(quoted[n], F.lit("")) for n in names))
        fields, good = F.when(good & ~F.contains("value", F.lit('"')), parts).otherwise(again), good | F.contains("value", F.lit('"'))
    else:
        fields = parts
    rows = lines.select(good.alias("_good"), fields.alias("_f"), F.col("value"))
    wide = rows.select("_good", *(F.when(F.size("_f") == len(names), F.get("_f", F.lit(i))).alias(n) for i, n in enumerate(names)))
    timed = wide.withColumn("ts_s", F.when(F.col("_good"), finite(F.col(ts))))
    counts = timed.agg(F.count("*").alias("rows_n"), F.count_if(~F.col("_good")).alias("malformed"), F.count_if(F.col("_good") & F.col("ts_s").isNull()).alias("bad_time"))
    return timed.where("_good and ts_s is not null").drop("_good"), counts


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """S3: a quoted, possibly multi-line CSV file as text columns, with ``ordinal``, the place of each row in the file."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    # Rows of one file are in order within a task, and tasks in order of the files' parts.
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def split_provenance(rows: DataFrame, kind: str = "type", id: str = "id", ts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (Process or Artifact with an id, the last row of each id) and edges (all else with a usable time)."""
    node = F.col(kind).isin("Process", "Artifact") & (F.coalesce(F.col(id), F.lit("")) != "")
    cols = [c for c in rows.columns if c != id]
    nodes = rows.where(node).groupBy(id).agg(F.max_by(F.struct(*cols), "ordinal").alias("_r")).select(id, *(F.col(f"_r.{c}").alias(c) for c in cols))
    edges = rows.where(~F.coalesce(node, F.lit(False))).withColumn("ts_s", ts if ts is not None else finite(F.col("time"))).where("ts_s is not null")
    return nodes, edges


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names; where it is unset, a local run gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back: what reads it several times computes it once."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One JSON object a line, fields in alphabetical order."""
    writer = df.select(sorted(df.columns)).write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _walk(name: str, kind: DataType) -> list[str]:
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in (f"{name}.{f.name}".lstrip("."), *_walk(f"{name}.{f.name}".lstrip("."), f.dataType))]
    if isinstance(kind, ArrayType):
        return _walk(name, kind.elementType)
    if isinstance(kind, MapType):
        return _walk(name, kind.valueType)
    return []


def forbidden_fields(df: DataFrame, tokens: Iterable[str] = FORBIDDEN) -> list[str]:
    """Fields at any depth whose name holds a forbidden token."""
    norm = lambda s: "".join(ch if ch.isalnum() else "_" for ch in s.rsplit(".", 1)[-1].lower())
    return [p for p in _walk("", df.schema) if any(t in norm(p) for t in tokens)]


def require(df: DataFrame, columns: Iterable[str] = (), key: str | None = None, finite_columns: Iterable[str] = ()) -> DataFrame:
    """One row of violation counts: missing columns, null or repeated keys, values that are not finite."""
    missing = [c for c in columns if c not in df.columns]
    checks = [F.lit(len(missing)).alias("missing_columns"), F.count("*").alias("rows_n")]
    checks += [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"not_finite_{c}") for c in finite_columns]
    out = df.agg(*checks, *([F.count_if(F.col(key).isNull()).alias("null_keys")] if key else []))
    if key:
        out = out.crossJoin(df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated_keys")))
    return out


def leaking_rows(df: DataFrame, id: str) -> DataFrame:
    """Rows whose own id occurs in the JSON text of their other fields."""
    rest = F.to_json(F.struct(*(c for c in df.columns if c != id)))
    return df.where(F.contains(rest, F.col(id).cast("string")) & (F.length(F.col(id).cast("string")) > 0)).select(id)


def profile(df: DataFrame, ts: str, keys: list[str], label: str) -> DataFrame:
    """Rows and time range of each combination of ``keys``, over all rows and over labelled ones, with UTC text."""
    on = F.col(label) == 1
    iso = lambda c: F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows_n"), F.count_if(on).alias("labelled"), F.min(ts).alias("first_s"), F.max(ts).alias("last_s"),
        F.min(F.when(on, F.col(ts))).alias("first_labelled"), iso(F.min(ts)).alias("first_utc"),
    )


def overlap(a: DataFrame, b: DataFrame, ts: str = "ts_s") -> DataFrame:
    """How long two tables' time ranges overlap and how their ends differ; nulls where one is empty."""
    ra = a.agg(F.min(ts).alias("a0"), F.max(ts).alias("a1"))
    rb = b.agg(F.min(ts).alias("b0"), F.max(ts).alias("b1"))
    both = ra.crossJoin(rb)
    length = F.least("a1", "b1") - F.greatest("a0", "b0")
    known = F.col("a0").isNotNull() & F.col("b0").isNotNull()
    return both.select(F.when(known, F.greatest(F.lit(0.0), length)).alias("overlap_s"), (F.col("b0") - F.col("a0")).alias("start_offset_s"), (F.col("b1") - F.col("a1")).alias("end_offset_s"))
