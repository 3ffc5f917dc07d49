"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A conversation is a sequence of turns, a turn its 128-bit digest. Sequences are sorted over the
whole cluster, by sequence and then by id, so copies of one conversation split over blocks like
all others. Inside a block:

1. Neighbours are joined by an edge of the length of their common prefix.
2. Edges are taken in descending depth. Each one merges two components of neighbours, and a merge
   makes (or enlarges) the branching node of that depth; nodes with one child are filled in below.
3. What is left is the block's forest, joined at the textless root.

A node that another block may hold too is a prefix of what lies on both sides of a boundary; such
nodes are contracted to one row of partial sums and merged by the digest of their prefix. Members,
children, leaves and saved words are sums in which every sequence, child, leaf and turn is counted
in exactly one block: a child in the block where it begins, a leaf in the block where it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.llm.common import SPACES, materialize

#: Sequences and turns in a block, on average: what one task holds.
BLOCK = 200_000
#: Bytes of a turn's digest.
TURN = 16
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PARTIAL = f"{NODE}, block int, digest binary, parent_digest binary, ids binary"
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn, as lower-case hex; a null role or text is an empty one."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, t``: one row a turn, with ``t`` of its number, its digest and the words of its text.

    Turns without a conversation id belong to no conversation and are left out.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACES}]+"))
    t = F.struct(F.col(turn).alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"), words.alias("words"))
    return conversations.select(F.col(conv_id).cast("bigint").alias("conv_id"), t.alias("t")).where("conv_id is not null")


def _sequence(turns: Column) -> list[Column]:
    return [F.unhex(F.array_join(turns["digest"], "")).alias("key"), turns["words"].alias("words")]


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, key, words``: one row a conversation, its digests in the order of its turns and each turn's words.

    A null turn number comes first; turns of one number are in the order of their digests, and repeated
    rows are repeated turns. A conversation is 20 bytes a turn, however long its texts are.
    """
    turns = turns_of(conversations, conv_id, turn, role, text)
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", *_sequence(F.col("t")))


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """``sequences`` of conversations whose first turns come from the first conversation of their ``every``.

    Of conversation c the first h = crc32(c) mod ``heads`` turns are those of c - c mod ``every`` (all, if it
    has fewer; none, if it is absent), and its own turns follow from the h-th on, if any. The remainder
    of a negative id is SQL's, zero or negative.
    """
    turns = turns_of(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    # Grouped where the conversations of one base meet, so that its first turns are a window away.
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    own = own.withColumn("head", head).withColumn("h", h)
    first = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("own", 1, 0))
    own = own.withColumn("t", F.concat(first, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))))
    return own.select("conv_id", *_sequence(F.col("t")))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * TURN] == b[: middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


def _prefix_digests(key: bytes, depth: int) -> list[bytes]:
    """The digest of each prefix of ``key``, from the empty one to that of ``depth`` turns."""
    running, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for d in range(depth):
        running.update(key[d * TURN : (d + 1) * TURN])
        out.append(running.copy().digest())
    return out


class Forest:
    """The nodes of one block of sorted sequences. ``left`` and ``right`` are the common prefixes with its neighbours, -1 for none."""

    def __init__(self, keys: list[bytes], ids: list[list[int]], words: list[list[int]], left: int, right: int) -> None:
        self.keys, self.ids, self.words, self.left, self.right = keys, ids, words, left, right
        self.depth: list[int] = []
        self.low: list[int] = []  # the sequences below a node are low..high
        self.high: list[int] = []
        self.parent: list[int] = []
        self.least: list[int] = []
        self.members: list[int] = []
        self.children: list[int] = []  # those that begin in this block
        self.present: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.sequence: list[int] = []  # the sequence that ends at a node, or -1
        self.grow()

    def begins(self, node: int) -> bool:
        return self.low[node] > 0 or self.depth[node] > self.left

    def ends(self, node: int) -> bool:
        return self.high[node] < len(self.keys) - 1 or self.depth[node] > self.right

    def new(self, depth: int, low: int, high: int, least: int, sequence: int = -1, members: int = 0) -> int:
        values = (depth, low, high, -1, least, members, 0, 0, 0, 0, sequence)
        columns = (self.depth, self.low, self.high, self.parent, self.least, self.members, self.children, self.present, self.leaves, self.saved, self.sequence)
        for column, value in zip(columns, values):
            column.append(value)
        return len(self.depth) - 1

    def close(self, node: int) -> None:
        """Counts the node itself; all that lies below it is known."""
        depth = self.depth[node]
        if depth:
            words = self.words[self.low[node]][depth - 1]
            self.saved[node] += words * (self.members[node] - self.begins(node))
        if not self.present[node] and self.ends(node):
            self.leaves[node] += 1

    def attach(self, node: int, above: int) -> None:
        self.close(node)
        self.parent[node] = above
        self.low[above], self.high[above] = min(self.low[above], self.low[node]), max(self.high[above], self.high[node])
        self.least[above] = min(self.least[above], self.least[node])
        self.members[above] += self.members[node]
        self.children[above] += self.begins(node)
        self.present[above] += 1
        self.leaves[above] += self.leaves[node]
        self.saved[above] += self.saved[node]

    def lift(self, node: int, depth: int) -> int:
        """The node of ``depth`` above ``node``, after the nodes with one child between them."""
        while self.depth[node] > depth:
            above = self.new(self.depth[node] - 1, self.low[node], self.high[node], self.least[node])
            self.attach(node, above)
            node = above
        return node

    def grow(self) -> None:
        n = len(self.keys)
        top = [self.new(len(key) // TURN, k, k, min(ids), k, len(ids)) for k, (key, ids) in enumerate(zip(self.keys, self.ids))]
        leader = list(range(n))

        def find(k: int) -> int:
            while leader[k] != k:
                leader[k] = leader[leader[k]]
                k = leader[k]
            return k

        edges = [_common(a, b) for a, b in zip(self.keys, self.keys[1:])]
        for k in sorted(range(n - 1), key=lambda k: -edges[k]):
            a, b, depth = find(k), find(k + 1), edges[k]
            node = top[a]
            if self.depth[node] > depth:
                node = self.new(depth, self.low[node], self.high[node], self.least[node])
                self.attach(self.lift(top[a], depth + 1), node)
            self.attach(self.lift(top[b], depth + 1), node)
            leader[b], top[a] = a, node
        self.close(self.lift(top[find(0)], 0))

    def rows(self, block: int) -> pa.Table:
        digests = [_prefix_digests(self.keys[0], self.left), _prefix_digests(self.keys[-1], self.right)]
        opened: list[bytes | None] = []
        for k, depth in enumerate(self.depth):
            opened.append(digests[0][depth] if not self.begins(k) else digests[1][depth] if not self.ends(k) else None)
        ids = [None if s < 0 else ",".join(map(str, self.ids[s])).encode() for s in self.sequence]
        closed_ends = [None if o else NOBODY if i is None else hashlib.sha256(i).hexdigest() for i, o in zip(ids, opened)]
        above = [(None, None) if p < 0 else (None, opened[p]) if opened[p] else (self.least[p], None) for p in self.parent]
        columns = [
            self.least, self.depth, [p for p, _ in above], self.members, self.children, self.leaves, self.saved, closed_ends,
            [block] * len(self.depth), opened, [d for _, d in above], [i if o else None for i, o in zip(ids, opened)],
        ]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.int32()] + [pa.binary()] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in PARTIAL.split(", ")])


def _forest(rows: pa.Table, bounds: pa.Table) -> pa.Table:
    found = sorted(zip(rows["key"].to_pylist(), rows["conv_id"].to_pylist(), rows["words"].to_pylist()), key=lambda r: r[:2])
    keys: list[bytes] = []
    ids: list[list[int]] = []
    words: list[list[int]] = []
    for key, conv_id, counts in found:
        if keys and keys[-1] == key:
            ids[-1].append(conv_id)
        else:
            keys.append(key)
            ids.append([conv_id])
            words.append(counts)
    (bound,) = bounds.to_pylist()
    left = -1 if bound["before"] is None else _common(bound["before"], keys[0])
    right = -1 if bound["after"] is None else _common(keys[-1], bound["after"])
    return Forest(keys, ids, words, left, right).rows(bound["block"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each digest; rows come sorted by digest and block, and no ids are kept."""
    last, running = None, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([running.hexdigest()])], ["digest", "ends"])

    for batch in batches:
        for digest, ids in zip(batch.column(0), batch.column(2)):
            digest = digest.as_py()
            if digest == last:
                running.update(b",")
            else:
                if last is not None:
                    yield done()
                last, running = digest, hashlib.sha256()
            running.update(ids.as_py())
    if last is not None:
        yield done()


def prefix_trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes of the trie over ``seqs`` (``conv_id, key, words``, as ``sequences`` gives them).

    A node is a distinct sequence of first turns; it carries its smallest member, its depth, its
    parent's smallest member (null for the root), its numbers of members, children and leaves below it,
    the words that sharing saves in it and below it, and the SHA-256 of the ids that end at it.
    Members without turns belong to the root alone. An empty table has no nodes, not even a root.
    Repeated ids are members as often as they come.

    A block holds about ``block`` sequences and turns, whatever is common in them. One task hashes
    the ids that end at one node, as SHA-256 has no parts; it reads one row a block and keeps none.
    """
    seqs = materialize(seqs)
    size = seqs.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    dealt = materialize(seqs.repartitionByRange(-(-size // block) or 1, "key", "conv_id").withColumn("block", F.spark_partition_id()))
    in_order = Window.orderBy("block")  # one row a block
    bounds = dealt.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    bounds = bounds.select("block", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after"))
    nodes = materialize(dealt.groupBy("block").cogroup(bounds.groupBy("block")).applyInArrow(_forest, PARTIAL))

    opened = nodes.where("digest is not null")
    ids = opened.where("ids is not null").select("digest", "block", "ids").repartition("digest").sortWithinPartitions("digest", "block")
    ends = ids.mapInArrow(_hash_ids, "digest binary, ends string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = opened.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_digest").alias("parent_digest"), *sums)
    merged = materialize(merged.join(ends, "digest", "left"))

    above = merged.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("above"))
    # A block asks only for nodes that it holds itself, so the root's children do not meet in one place.
    near = opened.select("block", F.col("digest").alias("parent_digest")).join(above, "parent_digest")
    columns = [c.split()[0] for c in NODE.split(", ")]
    closed = nodes.where("digest is null").join(near, ["block", "parent_digest"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    whole = merged.join(above, "parent_digest", "left").withColumnRenamed("above", "parent_conv_id").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOBODY)))
    return closed.select(columns).union(whole.select(columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: One bit of CRC-32 (reflected polynomial 0xEDB88320) is one step; a byte enters with the first of its eight.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295)"""

OP11_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.k < c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.k >= c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, length(role)::VARCHAR || ':' || role || text AS said, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
m AS (SELECT a.conv_id, a.d AS depth, a.words, sha256(string_agg(sha256(b.said), ',' ORDER BY b.d)) AS node FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.d <= a.d GROUP BY ALL
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
z AS (SELECT conv_id, max(depth) AS turns FROM m GROUP BY conv_id),
n AS (SELECT node, min(m.conv_id) AS conv_id, m.depth, min(m.words) AS words, count(*) AS n_convs, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE z.turns = m.depth) AS ends
  FROM m JOIN z ON z.conv_id = m.conv_id GROUP BY node, m.depth),
p AS (SELECT n.*, a.node AS parent FROM n LEFT JOIN m a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1),
k AS (SELECT parent, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent),
q AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM p LEFT JOIN k ON k.parent = p.node),
u AS (SELECT a.node, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((q.n_convs - 1) * q.words) AS saved_tokens FROM q JOIN m a ON a.conv_id = q.conv_id AND a.depth <= q.depth GROUP BY a.node)
SELECT q.conv_id, q.depth, a.conv_id AS parent_conv_id, q.n_convs, q.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(q.ends, '')) AS ends_sha256
FROM q JOIN u ON u.node = q.node LEFT JOIN q a ON a.node = q.parent"""
