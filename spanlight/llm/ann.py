"""Approximate nearest neighbours by largest inner product, with a permutation index.

A vector is represented by the order of the pivots around it, nearest (largest cosine) first. It
is posted in the inverted files of its first ``POST`` pivots; a query opens those of its first
``PROBE`` pivots. Inside a file the candidates are ranked by the footrule distance between their
first ``PLACES`` pivots and the query's, the nearer share of them is scored exactly, and the best of
all files win. A candidate that several opened files hold is ranked in the first of them only.

There are about as many pivots as the square root of the number of vectors, so a file holds a
falling part of them, and the share that is scored falls with the root of the number of pivots.
Files are dealt to tasks in blocks of a bounded number of postings, so a pivot that very many
vectors share is searched by many tasks. Pivots are a bounded hashed sample; every vector is
indexed, and queries are met with posted blocks. A query whose files hold fewer candidates than it
asks for is a rare one; such queries are scored against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.llm.common import in_batches, materialize

POST, PROBE, PLACES = 12, 16, 64
BLOCK = 8192
#: Pivots at most; they are sent to every task, 512 bytes each in 64 dimensions.
MOST_PIVOTS = 8192


def pivots_for(total: int) -> int:
    """A power of two near 1.2 times the root of ``total``; at least 32 vectors for each."""
    return max(1, min(MOST_PIVOTS, 1 << round(np.log2(max(1.0, 1.2 * total**0.5))), total // 32))


def share_for(pivots: int) -> float:
    """Part of a file's candidates that is scored."""
    return min(1.0, 2.5 / pivots**0.5)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors, stored as bytes of doubles, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The first ``PLACES`` pivots around each vector, nearest first; the direction alone decides."""
    unit = vectors / np.abs(vectors).max(1, keepdims=True)  # keeps the squares of huge and tiny values finite
    near = np.round(unit @ pivots.T / np.linalg.norm(unit, axis=1, keepdims=True), 9)
    return np.argsort(-near, 1, kind="stable")[:, :PLACES].astype(np.int16)


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id, v`` (doubles) of rows with an id and a vector that is not null or zero and has only finite components; one for each id, the smallest."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    kept = rows.select(F.col(id).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


def _posted(rows: DataFrame, pivots: np.ndarray, first: int, blocks: dict[int, int] | None, all_blocks: bool) -> DataFrame:
    """A row for each vector and each of its ``first`` pivots: pivot, block, id, vector and order of the pivots.

    A vector lies in one block of a file; a query (``all_blocks``) goes to all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), np.stack([v.values.to_numpy() for v in batch.column(1)])
            orders = _orders(x, pivots)
            pivot = orders[:, :first].astype(np.int64).ravel()
            owner = np.repeat(np.arange(len(x)), min(first, orders.shape[1]))
            block = np.zeros(len(owner), np.int64)
            if blocks is not None:
                n = np.array([blocks.get(p, 1) for p in range(len(pivots))])[pivot]
                if all_blocks:
                    owner, pivot, block = np.repeat(owner, n), np.repeat(pivot, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                else:
                    block = ((ids[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
            raw, where = [r.tobytes() for r in x], [r.tobytes() for r in orders]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(ids[owner]), pa.array([raw[k] for k in owner], pa.binary()), pa.array([where[k] for k in owner], pa.binary())],
                ["pivot", "block", "id", "v", "orders"],
            )

    return in_batches(rows).mapInArrow(run, "pivot int, block int, id bigint, v binary, orders binary")


_FOUND = "query_id bigint, vec_id bigint, score double"


def _table(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    near = np.arange(len(ids))
    if len(near) > k:  # only the best and what ties with the last of them has to be ordered
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search_block(queries: pa.Table, posted: pa.Table, pivot: int, k: int, share: float, dims: int, n_pivots: int) -> pa.Table:
    """The best ``k`` of a block for each query that opened its file; either side may be empty."""
    if not queries.num_rows or not posted.num_rows:
        return _table([])
    posted, places = posted.sort_by("id"), min(PLACES, n_pivots)
    x, ids = _matrix(posted.column("v"), dims), posted.column("id").to_numpy()
    orders = np.frombuffer(b"".join(posted.column("orders").to_pylist()), np.int16).reshape(-1, places)
    by_pivot = np.full((n_pivots, len(ids)), places, np.int16)  # place of each pivot around each vector
    by_pivot[orders.astype(np.int64).T, np.arange(len(ids))] = np.arange(places, dtype=np.int16)[:, None]
    found, mine = [], np.arange(places, dtype=np.int16)[:, None]
    rows = zip(_matrix(queries.column("v"), dims), queries.column("id").to_pylist(), queries.column("orders").to_pylist(), strict=True)
    for q, q_id, order in rows:
        order = np.frombuffer(order, np.int16).astype(np.int64)
        fresh = ids != q_id
        earlier = order[: int(np.flatnonzero(order == pivot)[0])]
        if len(earlier):  # what an earlier file holds is ranked there
            fresh &= by_pivot[earlier].min(0) >= POST
        at = np.flatnonzero(fresh)
        n = min(len(at), max(20 * k, int(np.ceil(share * len(at)))))
        if n < len(at):
            theirs = by_pivot[order][:, at]
            # Footrule over the query's pivots; the vector's other pivots add what is left of a constant.
            foot = (np.abs(theirs - mine) + theirs).sum(0, dtype=np.int32)
            at = at[np.sort(np.argsort(foot, kind="stable")[:n])]  # ids ascend, so equal distances keep the smaller
        scores = x[at] @ q
        best = _best(ids[at], scores, k)
        found.append((np.full(len(best), q_id), ids[at[best]], scores[best]))
    return _table(found)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, queries: DataFrame, total: int, k: int, dims: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of each block of rows for each query."""
    blocks = max(1, -(-total // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def run(key: tuple, q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return _table([])
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        x, ids, found = matrix(p), p.column("vec_id").to_numpy(), []
        for v, q_id in zip(matrix(q), q.column("vec_id").to_pylist(), strict=True):
            at = np.flatnonzero(ids != q_id)
            scores = x[at] @ v
            best = _best(ids[at], scores, k)
            found.append((np.full(len(best), q_id), ids[at[best]], scores[best]))
        return _table(found)

    return asked.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(run, _FOUND)


def neighbours(rows: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 20, pivots: int | None = None, share: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows found with the largest inner products.

    Ties go to the smaller id and a query does not find rows of its own id. An id stands for one
    vector: of repeated rows one counts, and of several vectors the smallest. Rows or queries
    without a usable vector, or with another number of components than most rows have, take no
    part; other columns are ignored. ``share`` of a file's candidates are scored exactly, but
    never fewer than ``20 * k``. Every query gets ``k`` rows, or all others if there are fewer.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    every = usable(rows, id, vector)
    sizes = every.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, total = sizes["dims"], sizes["count"]
    vectors, asked = every.where(F.size("v") == dims), usable(queries, id, vector).where(F.size("v") == dims)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots or pivots_for(total)).collect()
    raw = np.unique(np.array([r.v for r in sample]), axis=0)
    unit = raw / np.abs(raw).max(1, keepdims=True)
    centres = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    part = share or share_for(len(centres))
    counts = _posted(vectors, centres, POST, None, False).groupBy("pivot").count().collect()
    blocks = {r.pivot: -(-r["count"] // BLOCK) for r in counts}
    posted = _posted(vectors, centres, POST, blocks, False)
    opened = _posted(asked, centres, PROBE, blocks, True)

    def run(key: tuple, q: pa.Table, p: pa.Table) -> pa.Table:
        return search_block(q, p, key[0].as_py(), k, part, dims, len(centres))

    found = materialize(_ranked(opened.groupBy("pivot", "block").cogroup(posted.groupBy("pivot", "block")).applyInArrow(run, _FOUND), k))
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
    lacking = materialize(asked.join(full, "vec_id", "left_anti"))
    if lacking.isEmpty():
        return found
    rest = _ranked(exact(vectors, lacking, total, k, dims), k)
    return found.join(lacking.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(rest)


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(rows, rows.where(F.col("vec_id") % 20 == 0))
