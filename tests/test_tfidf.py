"""TF-IDF over the commonest terms against plain Python."""

import math
import random
from collections import Counter

import pytest
from spanlight.operators.models import tfidf


@pytest.mark.parametrize("terms", [1, 3, 8, 40, 10_000])
def test_commonest_terms(spark, terms):
    rng = random.Random(terms)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "x", "été"]
    docs = [(i, " ".join(rng.choices(words, weights=[9, 7, 5, 3, 2, 1, 4, 2], k=rng.choice([0, 1, 2, 9, 30])))) for i in range(60)] + [(99, None), (100, "aa bb " * 200)]
    grams = {i: [w for w in (t or "").split() if len(w) > 1] for i, t in docs}
    grams = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in grams.items()}
    total = sum(grams.values(), Counter())
    chosen = sorted(total, key=lambda t: (-total[t], t))[:terms]
    df = {t: sum(t in c for c in grams.values()) for t in chosen}
    want = {}
    for i, c in grams.items():
        v = {t: (1 + math.log(c[t])) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in chosen if c[t]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        want |= {(i, t): x / norm for t, x in v.items()}
    got = {(r.k, r.term): r.value for r in tfidf(spark.createDataFrame(docs, "k int, said string"), "k", "said", terms).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
