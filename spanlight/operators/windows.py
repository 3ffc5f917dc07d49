"""Tumbling windows, gap clusters and merged intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def bucket(ts: Column, width: float) -> Column:
    """Start of the window that holds ``ts``."""
    return (F.floor(ts / width) * width).cast("bigint")


def text_map(key: Column, value: Column) -> Column:
    """Aggregate ``key=value`` entries into one text, sorted by key."""
    return F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, value.cast("string")))), ",")


def window_profile(rows: DataFrame, width: float, numeric: Iterable[str], flags: Iterable[str], shares: dict[str, Column], ts: str = "ts_s") -> DataFrame:
    """One row for each window: rows; mean, population deviation and largest of the finite values of
    ``numeric``; means of ``flags`` and shares of conditions over all rows. One aggregation with
    partial sums, so what is shuffled is a row for each window and task."""
    n = F.count("*")
    aggs = [n.alias("row_count")]
    for c in numeric:
        x = F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
        mean = F.coalesce(F.avg(x), F.lit(0.0))
        aggs += [
            F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{c}_sum"),
            mean.alias(f"{c}_mean"),
            F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.avg(x * x) - F.avg(x) * F.avg(x))), F.lit(0.0)).alias(f"{c}_std"),
            F.coalesce(F.max(x), F.lit(0.0)).alias(f"{c}_max"),
        ]
    aggs += [(F.sum(F.col(c)) / n).alias(f"{c}_mean") for c in flags]
    aggs += [(F.count_if(cond) / n).alias(f"{name}_share") for name, cond in shares.items()]
    return rows.groupBy(bucket(F.col(ts), width).alias("window_start")).agg(*aggs)


def value_spread(rows: DataFrame, by: list[Column], dimensions: list[str]) -> DataFrame:
    """Distinct values and concentration (sum of squared shares) of each dimension within each group.

    Values are counted in long form first, so no group's values meet in memory.
    """
    values = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dimensions)))
    keys = [c for c in rows.select(*by).columns]
    counts = rows.select(*by, values.alias("v")).groupBy(*keys, "v.dimension", "v.value").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys, "dimension").agg(
        F.count("*").alias("distinct_values"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi")
    )


def dense(windows: DataFrame, width: int, start: str = "window_start") -> DataFrame:
    """All windows from the first to the last; numbers of windows that were missing are 0."""
    span = windows.agg(F.min(start).alias("lo"), F.max(start).alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi", F.lit(width).cast("bigint"))).alias(start))
    numeric = [c for c, t in windows.dtypes if t in ("bigint", "int", "double")]
    return spine.join(windows, start, "left").na.fill(0, numeric)


def touched_windows(intervals: DataFrame, width: int, start: str, end: str) -> DataFrame:
    """A row for each interval and each window that it touches, both ends included."""
    steps = F.sequence(bucket(F.col(start), width), bucket(F.col(end), width), F.lit(width).cast("bigint"))
    return intervals.withColumn("window_start", F.explode(steps))


def gap_clusters(rows: DataFrame, keys: list[str], ts: str, gap: float, block: float = DAY) -> DataFrame:
    """``rows`` with ``cluster_n``, the running number of their cluster within their key.

    A step of more than ``gap`` to the row before starts a new cluster; an equal step does not.
    Rows are compared inside blocks of time, and only one summary row for each block is ordered
    over a whole key, so a few keys with very many rows spread over as many tasks as there are
    blocks. The result is that of one ordered pass over each key.
    """
    at = rows.withColumn("block", F.floor(F.col(ts) / block))
    inside = Window.partitionBy(*keys, "block").orderBy(ts)
    step = F.col(ts) - F.lag(ts).over(inside)
    marked = at.withColumn("fresh", F.when(step.isNull(), 0).when(step > gap, 1).otherwise(0))
    over_key = Window.partitionBy(*keys).orderBy("block")
    blocks = marked.groupBy(*keys, "block").agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.sum("fresh").alias("breaks"))
    apart = F.coalesce(F.col("lo") - F.lag("hi").over(over_key) > gap, F.lit(True)).cast("int")
    blocks = blocks.withColumn("opens", apart).withColumn("before", F.sum(F.col("opens") + F.col("breaks")).over(over_key) - F.col("breaks"))
    numbered = marked.join(blocks.select(*keys, "block", "before"), [*keys, "block"])
    return numbered.withColumn("cluster_n", (F.col("before") + F.sum("fresh").over(inside.rangeBetween(Window.unboundedPreceding, 0))).cast("bigint")).drop("block", "fresh", "before")


def case_summary(observations: DataFrame, gap: float) -> DataFrame:
    """Incident cases: clusters of both views' observations by tactic, with counts and ranges by view."""
    c = gap_clusters(observations, ["tactic"], "ts_s", gap)
    aggs = [F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.count("*").alias("rows_n")]
    for v in ("network", "provenance"):
        here = F.col("view") == v
        aggs.append(F.count_if(here).alias(f"{v}_n"))
    for v in ("network", "provenance"):
        here = F.col("view") == v
        aggs += [F.min(F.when(here, F.col("ts_s"))).alias(f"{v}_start"), F.max(F.when(here, F.col("ts_s"))).alias(f"{v}_end")]
    out = c.groupBy("tactic", "cluster_n").agg(*aggs)
    return out.withColumn("case_id", F.concat_ws("_", "tactic", F.lpad(F.col("cluster_n").cast("string"), 4, "0")))


def gap_sweep(rows: DataFrame, key: str, ts: str, gaps: Iterable[float], block: float = DAY) -> DataFrame:
    """Number of clusters of each key, and over all keys, for several gaps.

    As in ``gap_clusters``, steps are taken inside blocks of time, and only one summary row for
    each block is ordered over a whole key.
    """
    at = rows.select(key, ts, F.floor(F.col(ts) / block).alias("block"))
    step = F.col(ts) - F.lag(ts).over(Window.partitionBy(key, "block").orderBy(ts))
    inside = [F.count_if(F.col("step") > g).alias(f"in{int(g)}") for g in gaps]
    blocks = at.withColumn("step", step).groupBy(key, "block").agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), *inside)
    apart = F.col("lo") - F.lag("hi").over(Window.partitionBy(key).orderBy("block"))
    wide = blocks.withColumn("apart", apart).groupBy(key).agg(
        *((F.sum(f"in{int(g)}") + F.count_if(F.col("apart").isNull() | (F.col("apart") > g))).alias(f"g{int(g)}") for g in gaps)
    )
    long = wide.select(key, F.explode(F.array(*(F.struct(F.lit(int(g)).alias("gap"), F.col(f"g{int(g)}").alias("clusters")) for g in gaps))).alias("x")).select(key, "x.gap", "x.clusters")
    return long.unionByName(long.groupBy("gap").agg(F.sum("clusters").alias("clusters")).withColumn(key, F.lit("all")))


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals that cover the same points; intervals that touch become one.

    An interval opens a new group when it starts after the largest end of all before it.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_open", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    grouped = opened.withColumn("_n", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_n").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_n")


def points_inside(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str, end: str, width: float) -> DataFrame:
    """Semi-join of points and merged intervals with closed ends, by equal time buckets of ``width``."""
    cut = touched_windows(intervals, int(width), start, end).select(*keys, F.col("window_start").alias("_w"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    p = points.withColumn("_w", bucket(F.col(ts), width))
    cond = (p["_w"] == cut["_w"]) & (p[ts] >= cut["_a"]) & (p[ts] <= cut["_b"])
    for k in keys:
        cond = cond & (p[k] == cut[k])
    return p.join(cut, cond, "left_semi").drop("_w")
