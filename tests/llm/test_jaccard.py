"""Near-duplicates of the pipeline's stage against all pairs."""

import random

import pytest
from pyspark.sql import functions as F
from spanlight.llm import jaccard


def slow(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def slow_roots(texts):
    sets, parent = [slow(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 300))]
        out.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(max(1, len(base) // rng.choice((20, 40, 60, 100)))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    out += [f"{passage} {' '.join(word() for _ in range(60))}" for _ in range(30)]
    out += ["", None, " \n", "one two", "ONE  two", "one"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_groups_are_those_of_all_pairs(spark, texts, rounds, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    want = slow_roots(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    root = {r.id: r.root for r in jaccard.groups(df).collect()}
    assert len({(want[i], root[i]) for i in root}) == len(set(want)) == len(set(root.values()))


def test_copies_beyond_three_bits_go(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in jaccard.deduplicate(df).collect()} == set(slow_roots(texts))


def test_repeated_and_missing_ids(spark):
    long = " ".join(f"a{i}" for i in range(50))
    rows = [(1, long, "x"), (1, long, "x"), (1, long, "y"), (1, "something else here", "x"), (2, long + " end", "x"), (None, long, "x"), (None, long, "x"), (3, "alone", "x")]
    out = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert sorted((r.doc_id or 0, r.text[:5], r.source) for r in out.collect()) == sorted([(0, "a0 a1", "x"), (0, "a0 a1", "x"), (1, "a0 a1", "x"), (1, "somet", "x"), (3, "alone", "x")])
    assert out.where(F.col("doc_id").isNull()).count() == 2


def test_texts_of_one_template_do_not_meet(spark):
    template = " ".join(f"t{i}" for i in range(11))
    rows = [(i, f"{template} own{i}") for i in range(3000)]
    # Two that are alike beside the template, so that the key has something to find.
    rows += [(5000, f"{template} {' '.join(f'x{i}' for i in range(30))}"), (5001, f"{template} {' '.join(f'x{i}' for i in range(30))} more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    prints = jaccard.posted(jaccard._texts(df, "doc_id", "text"), 5, 0.8)
    now = jaccard._members(prints).withColumn("root", F.col("node"))
    assert jaccard._rest(now, 0.8).count() < 20 * len(rows)
    root = {r.id: r.root for r in jaccard.groups(df).collect()}
    assert root[5000] == root[5001] and len(set(root.values())) == 3001


@pytest.mark.parametrize("part", [3, 20_000])
def test_hot_values_are_split_without_loss(spark, texts, part, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", part)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    now = jaccard._members(jaccard.posted(jaccard._texts(df, "doc_id", "text"), 5, 0.8)).withColumn("root", F.col("node"))
    found = {(r.a, r.b) for r in jaccard._rest(now, 0.8).collect()}
    nodes = {jaccard.node_of(jaccard.words_of((t or "").encode())): slow(t) for t in texts}
    keys = sorted(n for n in nodes if nodes[n])
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(nodes[a] & nodes[b]) >= 0.8 * len(nodes[a] | nodes[b])}
    assert want and want <= found and all(a < b for a, b in found)


def test_copies_around_one_text_meet_it_first(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        copy = list(base)
        for k in rng.sample(range(10, 140, 10), 3):  # alike to the base, and hardly any to each other
            copy[k + rng.randrange(5)] = f"own{i}_{k}"
        rows.append((i, " ".join(copy)))
    left, rest = [], jaccard._rest

    def counted(*args):
        found = rest(*args)
        left.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_rest", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert len({r.root for r in jaccard.groups(df).collect()}) == 1
    assert left[0] < 5 * len(rows)
