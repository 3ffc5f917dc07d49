"""Ranked lexical search against a brute-force version."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from spanlight.llm import lexical
from spanlight.llm.common import materialize

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_words = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_words
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if c[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def table(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["the"] * 60 + ["Été", "ß", " x", "İ", "A-b_c"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(10**6 + i, docs[3][1]) for i in range(n // 3)]  # a third are copies
    docs += [(5000, None), (5001, ""), (5002, "?!"), (None, "w1 w2"), (5003, "the " * 9000), (3, docs[3][1])]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(15)] + [(90, None), (91, ""), (92, "unknownterm"), (93, "the the THE"), (94, docs[3][1]), (0, "more w1")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("seed", "n", "words", "together", "window"), [(1, 300, 10**6, 256, 4096), (2, 700, 3000, 4, 64), (3, 400, 1, 256, 7)])
def test_against_brute_force(spark, monkeypatch, seed, n, words, together, window):
    docs, items = table(seed, n)
    if words == 1:
        docs = docs[:60]  # every document a shard
    df = spark.createDataFrame([(*d, "t", 1.0) for d in docs], "doc_id bigint, text string, term string, score double").repartition(3)
    index = materialize(lexical.build_index(df, words=words))
    found = lexical.search(index, spark.createDataFrame(items, "item_id bigint, text string"), together=together, window=window)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical.search(materialize(lexical.build_index(none)), items).count() == 0
    index = materialize(lexical.build_index(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")))
    assert lexical.search(index, items.limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**60)))
def test_packing_whole_numbers(values):
    data, ends = lexical.pack(np.array(values, np.int64))
    assert lexical.unpack(data).tolist() == values and len(ends) == len(values)


@given(st.text(max_size=60))
def test_terms(text):
    assert [t.decode() for part in lexical.terms_of(text) for t in part] == terms(text)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PART", 16)
    text = "several short words " * 9 + "x" * 50 + " end " + "y" * 40
    assert [t.decode() for part in lexical.terms_of(text) for t in part] == terms(text)


def test_blocks_stay_shut():
    """With a rare strong term and a common weak one, most blocks of the common list are never decompressed."""
    shard = lexical.Shard()
    for i in range(40_000):
        shard.add(i, "common filler" + " word" * (i % 7) + (" rare rare rare" if i % 997 == 5 else ""))
    head, *rows = list(shard.rows(0))
    lengths = np.frombuffer(head.column("lengths")[0].as_py(), "<i8")
    ids = np.frombuffer(head.column("doc_ids")[0].as_py(), "<i8")
    lists = lexical.shard_lists(lexical.pa.Table.from_batches(rows), lengths, len(ids), int(lengths.sum()))
    asked = [(7000, lists["rare"]), (3, lists["common"]), (2, lists["filler"])]
    best_ids, best = lexical.search_item(asked, ids, 10, 4096)
    scores = sum(w * p.at(np.arange(len(ids))) for w, p in [(w, lexical.shard_lists(lexical.pa.Table.from_batches(rows), lengths, len(ids), int(lengths.sum()))[t]) for w, t in [(7000, "rare"), (3, "common"), (2, "filler")]])
    order = np.lexsort((ids, -scores))[:10]
    assert best_ids.tolist() == ids[order].tolist() and best.tolist() == scores[order].tolist()
    assert lists["common"].open.mean() < 0.2 and lists["filler"].open.mean() < 0.2


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    df = lexical.op13_block_max(spark, folder)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({lexical.OP13_SQL})").fetchall()
    assert len(want) and sorted([tuple(r) for r in df.collect()], key=str) == sorted(want, key=str)
