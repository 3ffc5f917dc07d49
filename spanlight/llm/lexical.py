"""Ranked lexical search over sharded inverted lists by Block-Max MaxScore.

An index row is the list of one term in one shard: documents in ascending places, 128 to a block, each
block compressed by itself. Beside the compressed blocks lie the last place of each and the pairs
(frequency, document length) that no other document of the block beats in both. A score grows with
the frequency and falls with the length whatever the corpus' statistics are, so the exact maximum of
a block follows from its pairs, and the index does not have to know the corpus.

Search of one item in one shard:

1. Lists are ordered by their largest possible contribution. The lists whose bounds add up to less than the
   tenth score so far are non-essential: a document in these alone cannot enter the heap.
2. Essential lists are read in windows of places; their documents are the candidates.
3. A candidate is rejected if its score so far and the maxima of the non-essential blocks that would
   hold it fall short of the tenth score. Only blocks with candidates left are decompressed, list by
   list, and every list read rejects more.

The heaps of all shards are merged. Shards are what one task indexed: bounded by words, so no list,
however common its term, is longer than a shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.llm.common import documents, in_batches, materialize, those_of

#: Fixed values of the measure: bytes that are no part of a term, and the case that is folded.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, HALF, FLOOR, SLOPE = 1_000_000_000, 8, 25, 75

#: Documents in a block of a list; words in a shard; places in a window; items that are searched together.
BLOCK, SHARD_WORDS, WINDOW, ITEMS = 128, 2_000_000, 4096, 256
#: Bytes of a text that are split at once, and index rows that leave Python at once.
PART, ROWS = 1 << 20, 20_000

INDEX = (
    "shard bigint, term string, n_docs bigint, n_words bigint, data binary, last array<int>, ends array<int>, tops array<int>, top_tf array<bigint>, top_n array<bigint>, "
    "doc_ids binary, lengths binary"
)
#: UTF-8 bytes of a term are ASCII letters and digits and all bytes above; all others separate.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in parts that bound what is held at once."""
    data = text.encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PART else data.rfind(b" ", at, at + PART) + 1 or (data.find(b" ", at + PART) + 1 or len(data))
        yield data[at:end].split()
        at = max(end, at + 1)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in 7 bits a byte, the last byte of each below 128; and where each number ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - sizes)[has] + k] = part + np.where(sizes[has] > k + 1, 128, 0).astype(np.uint64)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The whole numbers that ``pack`` wrote."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << 7 * k
    return out


class Shard:
    """Gathers the terms of documents and turns them into index rows."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int] = []
        self.terms: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.words = 0

    def add(self, doc_id: int, text: str) -> None:
        number = self.vocabulary.__getitem__
        parts = [np.fromiter(map(number, part), np.int64, len(part)) for part in terms_of(text)]
        n = sum(map(len, parts))
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.terms += parts
            self.words += n

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        lengths = np.array(self.lengths, np.int64)
        nothing = lambda n, kind: pa.nulls(n, kind)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        head = [pa.array([shard], pa.int64()), nothing(1, pa.string()), pa.array([len(self.ids)], pa.int64()), pa.array([self.words], pa.int64()), nothing(1, pa.binary())]
        head += [nothing(1, ints)] * 3 + [nothing(1, longs)] * 2
        yield pa.RecordBatch.from_arrays([*head, pa.array([np.array(self.ids, "<i8").tobytes()], pa.binary()), pa.array([lengths.astype("<i8").tobytes()], pa.binary())], names)

        places = np.repeat(np.arange(len(lengths)), lengths)
        keys, tf = np.unique(np.concatenate(self.terms) << 32 | places, return_counts=True)
        term, place = keys >> 32, keys & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(term, prepend=-1))
        n_docs = np.diff(first, append=len(term))
        within = np.arange(len(term)) - np.repeat(first, n_docs)
        starts = np.flatnonzero(within % BLOCK == 0)
        block_size = np.diff(starts, append=len(term))
        block = np.repeat(np.arange(len(starts)), block_size)
        n_blocks = -(-n_docs // BLOCK)

        gaps = np.diff(place, prepend=-1)
        gaps[first] = place[first] + 1
        inside = np.arange(len(term)) - starts[block]
        values = np.empty(2 * len(term), np.int64)
        values[2 * starts[block] + inside] = gaps
        values[2 * starts[block] + block_size[block] + inside] = tf
        data, value_ends = pack(values)
        block_ends = value_ends[2 * (starts + block_size) - 1]
        block_offsets = np.concatenate([[0], np.cumsum(n_blocks)])
        term_ends = block_ends[block_offsets[1:] - 1]
        term_offsets = np.concatenate([[0], term_ends])

        # The pairs that no other beats: frequencies fall, and a pair has to be shorter than all before it.
        n = lengths[place]
        order = np.lexsort((n, -tf, block))
        falling = n[order] - block[order] * (int(n.max()) + 1)
        least = np.minimum.accumulate(falling)
        top = order[np.concatenate([[True], falling[1:] < least[:-1]])]
        top_ends = np.cumsum(np.bincount(block[top], minlength=len(starts)))
        top_offsets = np.concatenate([[0], top_ends[block_offsets[1:] - 1]])
        per_term = np.repeat(np.arange(len(first)), n_blocks)

        lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
        size = len(first)
        columns = [
            pa.array(np.full(size, shard)), pa.array(list(self.vocabulary), pa.binary()).cast(pa.string()), pa.array(n_docs), nothing(size, pa.int64()),
            pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(term_offsets.astype(np.int32)), pa.py_buffer(data)]),
            lists(block_offsets, place[starts + block_size - 1], pa.int32()), lists(block_offsets, block_ends - term_offsets[per_term], pa.int32()),
            lists(block_offsets, top_ends - top_offsets[per_term], pa.int32()), lists(top_offsets, tf[top], pa.int64()), lists(top_offsets, n[top], pa.int64()),
            nothing(size, pa.binary()), nothing(size, pa.binary()),
        ]
        whole = pa.RecordBatch.from_arrays(columns, names)
        for at in range(0, size, ROWS):
            yield whole.slice(at, ROWS)


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHARD_WORDS) -> DataFrame:
    """The index of ``docs`` as a table: a row for each shard (``term`` is null) and one for each term in it.

    Texts are read whole. A document without terms, null and empty texts included, is in no list and no count; rows
    without an id are left out; repeated rows are documents of their own. An empty table has an empty
    index. Other columns are not read. No row is shuffled: a task indexes what it reads, and starts a
    new shard after ``words`` words (a longer text is a shard).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = Shard()
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, t.as_py())
                if shard.words >= words:
                    yield from shard.rows(number)
                    shard, number = Shard(), number + 1
        if shard.words:
            yield from shard.rows(number)

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return in_batches(rows).mapInArrow(run, INDEX)


class Postings:
    """One term's list in one shard, decompressed block by block where a search asks for it."""

    def __init__(self, row: dict, lengths_at: np.ndarray, norm: np.ndarray, norms_of) -> None:
        self.n, self.data = row["n_docs"], np.frombuffer(row["data"], np.uint8)
        self.last, self.ends, self.norm = row["last"], row["ends"], norm
        tops = row["tops"]
        best = impact(row["top_tf"], norms_of(row["top_n"]))
        #: The largest impact in each block, and in the whole list.
        self.peaks = np.maximum.reduceat(best, np.concatenate([[0], tops[:-1]]))
        self.peak = int(self.peaks.max())
        self.tops = best
        self.places, self.impacts = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        self.open = np.zeros(len(self.last), bool)

    def read(self, low: int, high: int) -> None:
        """Decompresses the blocks ``low`` to ``high`` (exclusive) that were not read before."""
        shut = np.flatnonzero(~self.open[low:high]) + low
        if not len(shut):
            return
        for run in np.split(shut, np.flatnonzero(np.diff(shut) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            values = unpack(self.data[self.ends[a - 1] if a else 0 : self.ends[b - 1]])
            at, to = a * BLOCK, min(b * BLOCK, self.n)
            full = (to - at) // BLOCK
            body = values[: 2 * BLOCK * full].reshape(full, 2, BLOCK)
            half = (len(values) - body.size) // 2
            gaps = np.concatenate([body[:, 0].ravel(), values[body.size : body.size + half]])
            tf = np.concatenate([body[:, 1].ravel(), values[body.size + half :]])
            places = np.cumsum(gaps) + (int(self.last[a - 1]) if a else -1)
            self.places[at:to], self.impacts[at:to] = places, impact(tf, self.norm[places])
            self.open[a:b] = True

    def window(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from ``start`` on and before ``end``, with their impacts."""
        low, high = np.searchsorted(self.last, [start, end])
        high = min(int(high) + 1, len(self.last))
        self.read(int(low), high)
        a, b = int(low) * BLOCK, min(high * BLOCK, self.n)
        x, y = np.searchsorted(self.places[a:b], [start, end]) + a
        return self.places[x:y], self.impacts[x:y]

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """The largest impact that each place can have, from the block it would be in."""
        block = np.searchsorted(self.last, places)
        return np.where(block < len(self.last), self.peaks[np.minimum(block, len(self.last) - 1)], 0)

    def reached(self, k: int) -> int:
        """An impact that ``k`` documents of the list reach, as far as its pairs tell without decompressing: 0 if there are fewer pairs."""
        return int(np.partition(self.tops, -k)[-k]) if len(self.tops) >= k else 0

    def at(self, places: np.ndarray) -> np.ndarray:
        """The impact of each of the ascending ``places``, 0 where the term is absent."""
        block = np.searchsorted(self.last, places)
        inside = block < len(self.last)
        out = np.zeros(len(places), np.int64)
        wanted = np.unique(block[inside])
        for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(wanted) else []:
            low, high = int(run[0]), int(run[-1]) + 1
            self.read(low, high)
            a, b = low * BLOCK, min(high * BLOCK, self.n)
            here = np.flatnonzero(inside & (block >= low) & (block < high))
            found = np.searchsorted(self.places[a:b], places[here]) + a
            same = self.places[found] == places[here]
            out[here[same]] = self.impacts[found[same]]
        return out


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + HALF * norm)


def norms(lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """The m of documents of these lengths."""
    if int(lengths.max(initial=0)) * SLOPE * n_docs >= 1 << 63:
        return np.array([FLOOR + SLOPE * n * n_docs // n_words for n in lengths.tolist()], np.int64)
    return FLOOR + SLOPE * lengths * n_docs // n_words


def search_item(lists: list[tuple[int, Postings]], ids: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (id, score) for lists with their weights; equal scores by ascending id."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: -x[0] * x[1].peak)
    tails = np.cumsum([0, *(w * p.peak for w, p in reversed(lists))])[::-1]
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    # Each pair is a document of its own, so some k documents score at least this.
    sure = max((w * p.reached(k) for w, p in lists), default=0)
    if lists and lists[0][1].n >= k:  # the strongest list is essential and read anyway
        w, p = lists[0]
        p.read(0, len(p.last))
        sure = max(sure, w * int(np.partition(p.impacts, -k)[-k]))
    for start in range(0, len(ids) if lists else 0, window):
        end = min(start + window, len(ids))
        # Nothing enters the heap below ``least``; one that equals it may, by its id.
        least = max(sure, int(best[-1]) if len(best) == k else 1)
        essential = int(np.searchsorted(-tails, -least, side="right"))
        if not essential:
            break
        score = np.zeros(end - start, np.int64)
        for w, p in lists[:essential]:
            places, impacts = p.window(start, end)
            score[places - start] += w * impacts
        places = np.flatnonzero(score)
        score = score[places]
        places += start
        rest = lists[essential:]
        # A whole list's bound rejects most; block maxima are looked up for those that are left.
        near = score + tails[essential] >= least
        places, score = places[near], score[near]
        bounds = np.zeros((len(rest) + 1, len(places)), np.int64)
        for j in range(len(rest) - 1, -1, -1):
            bounds[j] = bounds[j + 1] + rest[j][0] * rest[j][1].bounds(places)
        for j, (w, p) in enumerate(rest):
            near = score + bounds[j] >= least
            places, score, bounds = places[near], score[near], bounds[:, near]
            if not len(places):
                break
            score = score + w * p.at(places)
        near = score >= least
        best_ids, best = np.concatenate([best_ids, ids[places[near]]]), np.concatenate([best, score[near]])
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best


def shard_lists(rows: pa.Table, lengths: np.ndarray, n_docs: int, n_words: int) -> dict[str, Postings]:
    """The lists of one shard by term."""
    norm = norms(lengths, n_docs, n_words)
    plain = {c: rows[c].to_pylist() for c in ("term", "n_docs", "data")}
    arrays = {c: [v.values.to_numpy() for v in rows[c]] for c in ("last", "ends", "tops", "top_tf", "top_n")}
    out = {}
    for k, term in enumerate(plain["term"]):
        row = {"n_docs": plain["n_docs"][k], "data": plain["data"][k]} | {c: a[k] for c, a in arrays.items()}
        out[term] = Postings(row, lengths, norm, lambda n: norms(n, n_docs, n_words))
    return out


def search(index: DataFrame, items: DataFrame, id: str = "item_id", text: str = "text", k: int = 10, together: int = ITEMS, window: int = WINDOW) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0.

    ``index`` is a written table of ``build_index``. Rows of one item id are one item with the terms of all of them;
    null and empty texts have no terms, and items without known terms no rows; a null item id is an id
    like others. Items go through the shards in blocks of about ``together``; only the lists of their
    terms travel, and a task holds those of one shard. Empty tables give no rows.
    """
    heads = index.where("term is null").select("shard", "n_docs", "n_words", "doc_ids", "lengths")
    n_docs, n_words = heads.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    asked = items.select(F.col(id).cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    asked = materialize(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))
    blocks = -(-asked.select("item_id").distinct().count() // together) or 1

    lists = materialize(those_of(index.where("term is not null"), asked.select("term").distinct(), "term").drop("doc_ids", "lengths", "n_words"))
    found = lists.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(found, "term").select("item_id", "term", (F.col("times") * weight).cast("bigint").alias("weight"))
    weighted = materialize(weighted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")))
    packed = weighted.groupBy("block", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    packed = packed.groupBy("block").agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    wanted = lists.join(weighted.select("block", "term").distinct(), "term")
    places = heads.select("shard", "doc_ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(packed, "block")

    def run(rows: pa.Table, head: pa.Table) -> pa.Table:
        out: list[tuple[list, list, list]] = []
        if rows.num_rows and head.num_rows:
            ids = np.frombuffer(head["doc_ids"][0].as_py(), "<i8")
            by_term = shard_lists(rows, np.frombuffer(head["lengths"][0].as_py(), "<i8"), n_docs, n_words)
            for item in head["items"][0].as_py():
                mine = [(t["weight"], by_term[t["term"]]) for t in item["terms"] if t["term"] in by_term]
                best_ids, best = search_item(mine, ids, k, window)
                out.append(([item["item_id"]] * len(best), best_ids.tolist(), best.tolist()))
        columns = [pa.array([v for part in out for v in part[c]], pa.int64()) for c in range(3)]
        return pa.Table.from_arrays(columns, ["item_id", "doc_id", "score"])

    heaps = wanted.groupBy("block", "shard").cogroup(places.groupBy("block", "shard")).applyInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    best_first = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    # Each task keeps its own best k of an item before heaps meet.
    return heaps.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(build_index(documents(spark, sf_dir)))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT doc_id, r, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f CROSS JOIN s GROUP BY term, s.docs),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
x AS (SELECT q.item_id, n.doc_id, n.r, sum(q.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * n.n * s.docs) // s.words))))::BIGINT AS score
  FROM q JOIN w ON w.term = q.term JOIN f ON f.term = q.term JOIN n ON n.r = f.r CROSS JOIN s GROUP BY q.item_id, n.doc_id, n.r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
