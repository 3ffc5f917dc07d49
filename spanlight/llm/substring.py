"""Removal of long repeated spans by compacting a De Bruijn graph of token k-mers.

An edge of the graph is a window of 35 consecutive words; two edges follow each other if their
windows overlap in 34 words. Only edges that occur at two places or more matter. Dealing every
edge of the corpus by its hash would cost more disk than the texts themselves (README has the
figures), so edges that follow each other in a document and share their minimizer, the smallest
hash of the 8-word k-mers inside the window, are read as one path; a document of n words has about
n / 14 paths.

1. Paths are counted by minimizer and content. A whole path that occurs twice repeats in all of its
   edges. Equal windows have equal minimizers, so an edge whose minimizer occurs once is unique.
2. Repeated paths are the nodes of the compacted graph. A path goes on to the next one without a
   branch if all of its occurrences are followed by that path and all occurrences of that path
   follow it; this is a join of each path's only successor with each path's only predecessor.
   Occurrences that go on so become one span.
3. Where a minimizer occurs in different paths, the graph branches there, and one copy of each such
   path is taken edge by edge.
4. Spans and branching edges are read again at their source coordinates. The words that stand
   there are digested (128 bits of BLAKE2), and what has a digest of its own is no repeat.
5. What is left are word ranges of their documents, and the words they cover are removed.

A document is told by its id and a hash of its text, so rows may share an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm.common import documents, in_batches, materialize

WINDOW = 35
KMER = 8
#: Words hashed at once; blocks overlap by a window, so memory does not follow a text's length.
BLOCK = 1 << 17

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def _factors(place: np.ndarray) -> np.ndarray:
    """An odd factor for each place of a byte in its word, from 0 on."""
    return mix((place.astype(np.uint64) + np.uint64(1)) * _GOLDEN + np.uint64(7)) | np.uint64(1)


_PLACE = _factors(np.arange(4096))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash for each word, from its bytes and their places in it."""
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    factor = _PLACE[place] if len(_PLACE) > place.max() else _factors(place)
    return mix(np.add.reduceat(_BYTE[data] * factor, starts) + lengths.astype(np.uint64) * _GOLDEN)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, power, step, times = None, 0, h, 1, int(_MIX1)
    while True:
        factor = np.uint64(times)
        if n & step:
            if out is None:
                out, have = power, step
            else:  # the words already covered come first
                out = out[: len(h) - have - step + 1] * factor + power[have : have + len(h) - have - step + 1]
                have += step
            if have == n:
                return mix(out)
        power = power[:-step] * factor + power[step:] if len(power) > step else power[:0]
        times, step = times * times % 2**64, step * 2


def paths(h: np.ndarray, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Minimizer hash, content hash, first window and number of windows of every path."""
    n = len(h) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    seeds, edges = rolled(h, kmer), rolled(h, window)
    span = window - kmer + 1
    best, width = np.arange(len(seeds)), 1  # place of the smallest hash among ``width`` k-mers, the first of equals
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(seeds[b] < seeds[a], b, a)
        width += step
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    # First and last window overlap, so together they tell all words of a path.
    content = mix(edges[first] * _MIX1 + mix(edges[first + count - 1] + count.astype(np.uint64) * _GOLDEN))
    return seeds[best[first]], content, first, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def blocks(h: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text's word hashes with every window in exactly one of them."""
    for at in range(0, max(1, len(h) - window + 1), BLOCK):
        yield at, h[at : at + BLOCK + window - 1]


def read_paths(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``id, mark, seed, content, first, n`` of all paths of ``docs`` (``id, mark, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, t in enumerate(batch.column(2).cast(pa.binary())):
                h = word_hashes((t.as_py() or b"").split())
                for at, part in blocks(h, window):
                    seed, content, first, count = paths(part, window, kmer)
                    for into, x in zip(got, (np.full(len(seed), k), seed, content, first + at, count), strict=True):
                        into.append(x)
            owner, seed, content, first, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
            of = pa.array(owner.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), _signed(seed), _signed(content), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["id", "mark", "seed", "content", "first", "n"],
            )

    return in_batches(docs).mapInArrow(run, "id bigint, mark bigint, seed bigint, content bigint, first int, n int")


def compacted(occurrences: DataFrame) -> DataFrame:
    """``id, mark, first, n, joined``: occurrences of repeated paths, and whether they go on to the next one without a branch.

    ``occurrences`` has ``id, mark, first, n, node``. A node that very many documents hold is
    counted by partial sums, and its join is one of a row with many, which Spark can split.
    """
    each = materialize(occurrences.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("first", "n", "node"))).alias("p")))
    after, before = F.get("p", F.col("k") + 1), F.when(F.col("k") > 0, F.get("p", F.col("k") - 1))
    steps = each.select("id", "mark", F.posexplode("p").alias("k", "x"), "p").select(
        "id", "mark", F.col("x.first").alias("first"), F.col("x.n").alias("n"), F.col("x.node").alias("node"),
        F.when(after["first"] == F.col("x.first") + F.col("x.n"), after["node"]).alias("next"),
        F.when(before["first"] + before["n"] == F.col("x.first"), before["node"]).alias("prev"),
    )
    steps = materialize(steps)
    alone = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)) & (F.min(c) != F.col("node")), F.min(c))
    ends = materialize(steps.groupBy("node").agg(alone("next").alias("onto"), alone("prev").alias("source")))
    onward = ends.where("onto is not null").select("node", "onto")
    back = ends.where("source is not null").select(F.col("node").alias("onto"), F.col("source").alias("node"))
    links = onward.join(back, ["node", "onto"]).select("node", F.lit(True).alias("joined"))
    return steps.join(links, "node", "left").select("id", "mark", "first", "n", F.coalesce("joined", F.lit(False)).alias("joined"))


def _spans(parts: pa.StructScalar) -> Iterator[tuple[int, int]]:
    """First window and number of windows of each span: branching paths edge by edge, others as far as they are joined."""
    rows, at, size = sorted(parts.as_py(), key=lambda r: (r["branch"], r["first"])), None, 0
    for r in rows:
        if r["branch"]:
            yield from ((k, 1) for k in range(r["first"], r["first"] + r["n"]))
            continue
        at, size = (r["first"], r["n"]) if at is None else (at, size + r["n"])
        if not r["joined"]:
            yield at, size
            at = None


def read_again(chosen: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, mark, first, n, digest`` of every span of ``parts`` in each document of ``chosen`` (``id, mark, text, parts``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = (batch.column(2)[k].as_py() or "").encode().split()
                joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                spans = np.array(list(_spans(batch.column(3)[k])), np.int64).reshape(-1, 2)
                starts = np.concatenate(([0], ends[:-1] + 1))[spans[:, 0]].tolist()
                stops = ends[spans.sum(1) + window - 2].tolist()
                digests = [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(starts, stops, strict=True)]
                of = pa.array(np.zeros(len(spans), np.int64) + k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(spans[:, 0].astype(np.int32)), pa.array(spans[:, 1].astype(np.int32)), pa.array(digests, pa.binary())],
                    ["id", "mark", "first", "n", "digest"],
                )

    return in_batches(chosen).mapInArrow(run, "id bigint, mark bigint, first int, n int, digest binary")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``id, mark, ranges``: the first window and number of windows of all repeated runs in each document that has some."""
    every = materialize(read_paths(docs, window, kmer))
    # Copies of a path are counted where they are read, so a minimizer of very many copies is few rows.
    kinds = materialize(every.groupBy("seed", "content").agg(F.count("*").alias("places")))
    seeds = kinds.groupBy("seed").agg(F.sum("places").alias("c"), F.count("*").alias("kinds")).where("c > 1").select("seed", "kinds")
    known = materialize(kinds.join(seeds, "seed"))
    met = materialize(every.join(known, ["seed", "content"]).select("id", "mark", "first", "n", F.xxhash64("seed", "content").alias("node"), "places", "kinds"))
    whole = compacted(met.where("places > 1").select("id", "mark", "first", "n", "node")).select("id", "mark", "first", "n", "joined", F.lit(False).alias("branch"))
    copy = met.where("kinds > 1").groupBy("node").agg(F.min(F.struct("id", "mark", "first", "n")).alias("x"))
    branch = copy.select("x.*", F.lit(False).alias("joined"), F.lit(True).alias("branch"))
    marked = whole.union(branch).groupBy("id", "mark").agg(F.collect_list(F.struct("first", "n", "joined", "branch")).alias("parts"))
    again = materialize(read_again(docs.join(marked, ["id", "mark"]).select("id", "mark", "text", "parts"), window))
    # Written first, so that Spark can split the join at a digest of very many spans.
    common = materialize(again.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest"))
    found = again.join(common, "digest", "left_semi").select("id", "mark", "first", "n")
    return found.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "n")).alias("ranges"))


def _kept(words: list[bytes], ranges: list[dict] | None, window: int) -> list[bytes]:
    if not ranges:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        edge[r["first"]] += 1
        edge[r["first"] + r["n"] + window - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g]


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``id, n_words, n_removed, kept`` for every document: its words without those that a repeated window covers.

    Kept words are joined by one space. Null and empty texts have no words; texts shorter than a
    window lose none; repeated rows repeat each other's windows, and rows that share an id may
    have different texts. Rows without an id are dropped; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    joined = rows.join(repeated_ranges(rows, window, kmer), ["id", "mark"], "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for t, r in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = (t.as_py() or b"").split()
                left = _kept(words, r.as_py(), window)
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return in_batches(joined).mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id)


def op5_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p SEMI JOIN r USING (h)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM x ANTI JOIN g USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
