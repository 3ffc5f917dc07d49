"""Repeated spans against brute force: long words, shared ids, repeated rows, branching paths."""

import random
from collections import Counter

from spanlight.llm import substring


def slow(rows, window=35):
    words = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(tuple(r) for r in substring.drop_repeats(df.repartition(3)).collect())


def test_a_very_long_word(spark):
    s = " ".join(f"w{i}" for i in range(50))
    rows = [(1, s), (2, s + " " + "x" * 5000), (3, "y" * 9000 + " " + s), (4, "alone " * 3)]
    got = found(spark, rows)
    assert got == slow(rows) and [r[2] for r in got] == [50, 50, 50, 0]


def test_rows_that_share_an_id(spark):
    s = " ".join(f"w{i}" for i in range(50))
    rows = [(1, s), (1, "short"), (2, s), (3, None), (3, ""), (4, "b " + s), (4, "b " + s), (5, " ".join(f"v{i}" for i in range(60)))]
    assert found(spark, rows) == slow(rows)
    twice = [(7, rows[-1][1]), (7, rows[-1][1])]
    assert [r[2] for r in found(spark, twice)] == [60, 60]


def test_branching_paths(spark):
    rng = random.Random(3)
    part = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = part(120), part(40), part(60)
    rows = [(i, " ".join(x)) for i, x in enumerate([(a, part(20), b), (part(10), a, c), (b, c), (part(30), a), (c, part(50), c), (part(300),), (a, b), (" ".join(a.split()[30:80]), part(9)), ("again " * 90,), ("to and fro " * 40,)])]
    rows += [(100 + i, a) for i in range(30)]
    assert found(spark, rows) == slow(rows)
