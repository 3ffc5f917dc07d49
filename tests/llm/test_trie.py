"""The prefix trie against a brute-force version over whole conversations."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from spanlight.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return own, out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    below = defaultdict(list)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in who if n == len(node)))
        saved = sum((len(members[v]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", v[-1][1])) for v in below[node] if v)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        leaves = sum(not children[v] for v in below[node])
        out.append((min(who)[0], len(node), parent, len(who), children[node], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def table(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        said = "a" if c % 3 == 0 else rng.choice("abc")  # a third of all begin alike
        for t in range(rng.randrange(0, 7)):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "user", None]), rng.choice([said, said, "x y", None, " \t "])))
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 540) for t in range(3)]
    rows += [(900, t, "user", "again and again") for t in range(400)] + [(None, 1, "user", "nobody"), (-5, 2, None, None), (905, 1, "user", "no base for long"), (905, 1, "user", "no base for long")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 60, 7), (2, 60, 60), (3, 90, 10**6), (4, 25, 1)])
def test_rebuilt_conversations_in_any_blocks(spark, seed, n, block):
    rows = table(seed, n)
    _, convs = rebuild(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(trie.prefix_trie(trie.rebuilt(df), block)) == brute(list(convs.items()))


def test_own_sequences_and_other_columns(spark):
    rows = table(9, 40)
    own, _ = rebuild(rows)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], f"{SCHEMA}, key string, words int")
    assert got(trie.prefix_trie(trie.sequences(df), 50)) == brute(list(own.items()))


def test_a_group_of_copies_over_many_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)] + [(1000, t, "user", f"turn {t}") for t in range(5)]
    own, _ = rebuild(rows)
    assert got(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA)), 60)) == brute(list(own.items()))


def test_repeated_ids_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.rebuilt(empty)).count() == 0
    seqs = spark.createDataFrame([(1, bytearray(16), [2]), (1, bytearray(16), [2]), (2, bytearray(), [])], "conv_id bigint, key binary, words array<int>")
    found = {(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in trie.prefix_trie(seqs, 2).collect()}
    assert found == {(0, 3, 1, 1, 2), (1, 2, 0, 1, 2)}
    # Conversations without turns belong to the root alone.
    found = trie.prefix_trie(spark.createDataFrame([(7, bytearray(), []), (3, bytearray(), [])], "conv_id bigint, key binary, words array<int>")).collect()
    assert [tuple(r) for r in found] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    df = trie.op11_prefix_trie(spark, folder)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({trie.OP11_SQL})").fetchall()
    assert got(df) == sorted(want, key=str)
