"""Near-duplicate texts: SimHash balls find the close ones, shingle postings all that are alike enough.

Two texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8
or more. Such texts differ in about ten of 64 fingerprint bits, more than balls can reach, so the
stage has two parts, and every pair that either of them proposes is verified on the whole shingle
sets of both texts before it links:

1. Fingerprints of the same shingles meet by the balls of ``simhash``. A value becomes a star, so
   a large group of copies grows together for no more than its postings.
2. Two sets with a similarity of at least t share at least ceil(t * n) members, n being the size of
   the larger one. So if each text posts its first n - ceil(t * n) + 1 shingles under one order
   that all texts share, the two meet on a posting: no pair is lost, whatever the order is.
   Shingles that a sample of the texts finds common come last, so that a passage of many texts is
   posted by few of them. A posting carries how many shingles its text has from there on in that
   order. Two texts whose first shared shingle leaves them less than what they have to share are
   no pair; of two alike texts the smaller one posts it among its first ninth. So texts that have a
   template in common and too little else never meet, however many they are.

Exact copies count once. Each text is first compared with a few others that its posted values put
first, twice: with those that have the fewest shingles of their own, which are alike to the most
others, and with some by hash. By then groups have mostly grown together, and all pairs that are left,
those whose ends are not yet connected, are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.llm.common import BROADCAST_KEYS, free_name, in_batches, materialize, those_of
from spanlight.llm.components import connected_components
from spanlight.llm.simhash import linked, majority, shingle_hashes

#: Rounds of a few comparisons a text before all pairs that are left are verified.
ROUNDS = 2
#: Others that a text is compared with in such a round.
TRIES = 3
#: One document in so many says which shingles are common; only the order of postings depends on it.
SAMPLE = 16
COMMON, MOST_COMMON = 2, 400_000
#: Classes of equal texts that a task remembers, so that of copies it meets only the first posts.
REMEMBERED = 500_000
#: Members of a posted value that a task compares with the others of that value.
PART = 20_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """The distinct hashed shingles of a text in ascending order."""
    return np.unique(shingle_hashes(words, n))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def node_of(words: list[bytes]) -> int:
    """A signed 64-bit number that texts with the same words share."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def least_shared(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a text posts, as many as make sure that alike texts meet: the rare ones, and the common ones if those are too few."""
    if not len(hashes):
        return hashes, hashes
    keep = len(hashes) - least_shared(len(hashes), similarity) + 1
    weight = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, counts[at], 0)
    chosen = np.lexsort((hashes, weight))[:keep]
    return hashes[chosen[weight[chosen] == 0]], hashes[chosen[weight[chosen] > 0]]


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return in_batches(docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))


def common_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample have, ascending, and in how many of them they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(words_of(t.as_py()), n).view("<i8"))], ["key"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "key bigint")
    rows = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()
    keys = rows["key"].to_numpy(np.int64).view("<u8")
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy(np.int64)[order]


_LISTS = pa.list_(pa.int64())


def posted(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """``id, node, fp, size, keys, often``: class of equal texts, fingerprint, number of shingles, posted rare and common ones.

    Of the rows of one class only the first that a task meets has ``keys`` and ``often``.
    """
    common, counts = common_shingles(texts, n)
    sent = texts.sparkSession.sparkContext.broadcast((common, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, counts), met = sent.value, set()
        for batch in batches:
            found: list[tuple] = []
            for t in batch.column(1).cast(pa.binary()):
                words = words_of(t.as_py())
                node, every = node_of(words), shingle_hashes(words, n)
                hashes = np.unique(every)
                rare, often = prefix(hashes if node not in met else hashes[:0], common, counts, similarity)
                found.append((node, signed(majority(every)), len(hashes), rare.view("<i8"), often.view("<i8")))
                if len(met) < REMEMBERED:
                    met.add(node)
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), _LISTS, _LISTS), strict=True)] if found else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "node", "fp", "size", "keys", "often"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, node bigint, fp bigint, size bigint, keys array<bigint>, often array<bigint>")


def _ends(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())


def hopeful(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The rows ``a, b`` that can be alike by what both posted: beyond it they share at most all shingles that one of them did not post."""
    keys = F.concat("keys", "often")
    posts = those_of(prints.where(F.size(keys) > 0), _ends(pairs), "node").select("node", "size", keys.alias("keys"))
    posts = materialize(posts.dropDuplicates(["node"]))
    side = lambda c: posts.select(F.col("node").alias(c), F.col("size").alias(f"n_{c}"), F.col("keys").alias(f"of_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared + max(n - len(x), m - len(y)) >= similarity / (1 + similarity) * (n + m) - 1e-6)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_batches(both).mapInArrow(run, "a bigint, b bigint")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """``node, hashes``: the whole shingle set of each text, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, words), pa.int64()), pa.array([shingles(w, n).tobytes() for w in words], pa.binary())], ["node", "hashes"])

    return texts.select("text").mapInArrow(run, "node bigint, hashes binary")


def verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The rows ``a, b`` whose shingle sets have at least this Jaccard similarity; only their texts are read again."""
    ends = _ends(pairs)
    chosen = those_of(prints.select("id", "node"), ends, "node").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct()
    sets = materialize(those_of(_sets(those_of(texts, materialize(chosen), "id"), n), ends, "node").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_batches(both.select("a", "b", "of_a", "of_b"), 200).mapInArrow(run, "a bigint, b bigint")


def _alike(x: str, y: str, similarity: float) -> Column:
    """Sizes of which the smaller one can hold what the larger one has to share."""
    return F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9


def _ball_pairs(prints: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: texts of one fingerprint with the first of them, and the first texts of fingerprints that the balls link."""
    nodes = materialize(prints.where("size > 0").select("fp", "node", "size").distinct())
    heads = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head")))
    same = nodes.join(heads, "fp").where("node <> head.node").where(_alike("size", "head.size", similarity)).select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    side = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"of_{c}"))
    near = linked(heads).join(side("a"), "a").join(side("b"), "b").where(_alike("of_a.size", "of_b.size", similarity))
    return same.union(near.select("of_a.node", "of_b.node")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members(prints: DataFrame) -> DataFrame:
    """``node, size, rest, key`` of all postings that meet another text's; ``rest`` shingles of the text stand at the posted one or after it.

    Rare ones are dealt by their value once; both the test for a second text and what passes it
    read that one shuffle. Common ones, whose groups may be very large, pass without a test.
    """
    size = F.col("size").cast("int")
    place = lambda name, before: prints.select("node", size.alias("size"), before.alias("before"), F.posexplode(name).alias("at", "key")).select("node", "size", (F.col("size") - F.col("before") - F.col("at")).alias("rest"), "key")
    rare = place("keys", F.lit(0)).repartition("key")
    texts = F.struct("node", "size")
    met = rare.groupBy("key").agg(F.min(texts).alias("lo"), F.max(texts).alias("hi")).where("lo <> hi").select("key")
    return rare.join(met, "key", "left_semi").select("node", "size", "rest", "key").union(place("often", F.size("keys")).select("node", "size", "rest", "key"))


def _stars(members: DataFrame, turn: int, similarity: float) -> DataFrame:
    """``a, b``: each text with a few that its posted values put first in this turn, where they are not connected yet.

    At first a value's text with the most left for its size comes first: it has the fewest shingles of its own, so
    copies that lie around one text all meet that one, however many they are. Later it is one by hash. Of those
    first ones a text takes the ones that most of its values name.
    """
    middle = F.struct(-F.col("rest") / F.col("size"), F.xxhash64("node"), F.col("node"))
    order = F.struct(F.xxhash64("node", "key", F.lit(turn)), "node") if turn else middle
    first = members.groupBy("key").agg(F.min_by(F.struct("node", "size", "root"), order).alias("c"))
    met = members.join(first, "key").where("root <> c.root").where(_alike("size", "c.size", similarity))
    named = met.groupBy("node", F.col("c.node").alias("other")).agg(F.count("*").alias("n"))
    few = F.slice(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("node", "other"), "other")), asc=False), 1, TRIES)
    one = named.groupBy("node").agg(few.alias("few")).select("node", F.explode("few.other").alias("other"))
    return one.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _rest(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the pairs of a posted value that are not connected yet and can be alike if it is the first they share.

    Two texts of x and y shingles have to share t / (1 + t) * (x + y). From the first shared one on
    they share at most what is left of either, so a text can only meet those of up to ``most`` shingles, and
    the smaller of two only where its own size is not beyond its ``most``. One of the two is taken from those
    that qualify as the smaller; the members of a value's largest root meet only the others. A value
    with many members is split: one side is dealt to parts, the other goes to each.
    """
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("n")).where("roots > 1")
    several = several.select("key", "top", F.ceil(F.col("n") / F.lit(PART)).cast("int").alias("parts"))
    most = F.floor(F.col("rest") * F.lit((1 + similarity) / similarity) - F.col("size") + 1e-6)
    mine = materialize(members.join(several, "key").select("key", "node", "size", "root", "top", "parts", most.cast("int").alias("most")).distinct())
    side = lambda rows, c: rows.select("key", F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("size", "root", "most")), "part")
    dealt = lambda rows: side(rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "a")
    sent = lambda rows: side(rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))), "b")
    few, smaller = F.col("root") != F.col("top"), F.col("most") >= F.col("size")
    able = (F.col("root_a") != F.col("root_b")) & (F.col("size_a") <= F.col("most_b")) & (F.col("size_b") <= F.col("most_a"))
    pairs = [dealt(mine.where(x)).join(sent(mine.where(y)), ["key", "part"]).where(able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for x, y in ((few & smaller, F.lit(True)), (few, smaller))]
    return pairs[0].union(pairs[1]).distinct()


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id, node, root`` of each row: texts are connected by steps of at least this similarity.

    Null texts count as empty; texts without words are one group. Texts are told apart by 64 bits.
    """
    texts = _texts(docs, id, text)
    prints = materialize(posted(texts, shingle, similarity))
    members = materialize(_members(prints))
    edges = prints.sparkSession.createDataFrame([], "a bigint, b bigint")
    roots = prints.sparkSession.createDataFrame([], "node bigint, root bigint")
    for turn in range(ROUNDS + 1):
        now = members.join(roots, "node", "left").select("key", "node", "size", "rest", F.coalesce("root", "node").alias("root"))
        pairs = _stars(now, turn, similarity) if turn < ROUNDS else _rest(now, similarity)
        if not turn:
            pairs = pairs.union(_ball_pairs(prints, similarity)).distinct()
        able = materialize(hopeful(materialize(pairs), prints, similarity))
        new = materialize(verified(able, prints, texts, shingle, similarity))
        if not new.isEmpty():
            edges = edges.union(new)
            roots = connected_components(edges)
    return prints.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate group, one with its smallest id; all columns stay.

    Rows without an id stay, too. Null and empty texts and those without words are one group. Of
    equal rows one stays; where an id has several texts, each text counts for itself. An empty
    table stays empty.
    """
    whole = materialize(groups(docs.where(F.col(id).isNotNull()), id, text, shingle, similarity))
    best = whole.groupBy("root").agg(F.min(F.struct("id", "node")).alias("best")).select("best.id", "best.node")
    often = whole.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    best = materialize(best.join(often.withColumn("often", F.lit(True)), "id", "left"))
    # Those that go are fewer than those that stay, and few of them can be sent to where the texts lie.
    gone = materialize(whole.select("id").distinct().join(best.select("id"), "id", "left_anti").union(often).distinct()).select(F.col("id").alias(id))
    from_here = docs.where(F.col(id).isNotNull())
    once = from_here.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, id, "left_anti").select(docs.columns)
    # An id of several rows: those with other texts may belong elsewhere, and of equal ones a single row stays.
    node, place, key = (free_name(docs, c) for c in ("node", "place", "key"))
    wanted = best.where("often").select(F.col("id").alias(key), F.col("node").alias(node))
    again = those_of(docs, materialize(wanted.select(F.col(key).alias(id)).distinct()), id)
    again = again.withColumn(node, _node_column(F.col(text)))
    again = again.join(wanted, (again[id] == wanted[key]) & (again[node] == wanted[node]), "left_semi")
    order = Window.partitionBy(id, node).orderBy(F.to_json(F.struct(*docs.columns)))
    again = again.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(docs.columns)
    return once.union(again).union(docs.where(F.col(id).isNull()))


def _node_column(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def node(column: pd.Series) -> pd.Series:
        return pd.Series([node_of(words_of((t or "").encode())) for t in column], dtype="int64")

    return node(text)
