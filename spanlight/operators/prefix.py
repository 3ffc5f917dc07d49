"""Running sums in an order, without one task for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.sources.io import stored

#: Rows that one task orders.
BLOCK = 1_000_000


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], block: int | None = None) -> DataFrame:
    """``rows`` with the sums of columns over all rows of their keys up to and including their own, in ``order``.

    Rows are cut into ranges of (keys, order) of about ``block`` rows each. A range sums up by itself; one row for each
    range and key carries the sums of the ranges before it. A key with most of all rows is spread over as many tasks as it has
    ranges, and many small keys share one. Rows that tie in ``order`` come in any order among themselves.
    """
    rows = stored(rows)
    blocks = -(-rows.count() // (block or BLOCK)) or 1
    upto = Window.unboundedPreceding
    if blocks == 1:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(upto, 0)
        return rows.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    dealt = stored(rows.repartitionByRange(blocks, *keys, *order).withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(upto, 0)
    totals = dealt.groupBy("_block", *keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    # One row for each range that a key reaches into.
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(upto, -1)
    offsets = totals.select(F.col("_block").alias("_at"), *(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(offsets, same)
    return found.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_block", "_at", *(f"_k_{k}" for k in keys), *(f"_o_{n}" for n in sums))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, block: int | None = None) -> DataFrame:
    """``rows`` with their place among those of their keys, from 1."""
    return running(rows, keys, order, {name: F.lit(1).cast("bigint")}, block)


def tiles(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str, block: int | None = None) -> DataFrame:
    """``rows`` with the number, from 1 to ``n``, of the part of their key that they fall in; the first parts are one row longer where parts cannot be equal."""
    placed = numbered(rows, keys, order, "_place", block)
    sizes = placed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count("*").alias("_all"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    small, longer = F.floor(F.col("_all") / n), F.col("_all") % n
    edge = longer * (small + 1)
    tile = F.when(F.col("_place") <= edge, F.ceil(F.col("_place") / (small + 1))).otherwise(longer + F.ceil((F.col("_place") - edge) / F.greatest(small, F.lit(1))))
    return placed.join(sizes, same).withColumn(name, tile.cast("int")).drop("_place", "_all", *(f"_k_{k}" for k in keys))
