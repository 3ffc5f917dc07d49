"""Queries that read their whole tables, against plain Python on the smallest ones."""

import itertools
import math

import pytest
from spanlight.operators import resample as B
from spanlight.plans import views as V
from spanlight.plans.all import QUERIES

DATA = "/root/testdata/sf0.001"


def test_sign_flip_of_sizes(spark):
    values = [3, -1, 2, 2, -5, 1, 1, 0, 4]
    seen = abs(sum(values))
    sums = [abs(sum(s * v for s, v in zip(signs, values, strict=True))) for signs in itertools.product((1, -1), repeat=len(values))]
    got = B.sign_flip(spark.createDataFrame([(v,) for v in values], "d int")).first()
    assert got.p == pytest.approx(sum(s >= seen for s in sums) / len(sums)) and got["sum"] == sum(values)


def test_sign_flip_and_mcnemar_take_all_cases(spark):
    n, per = 0, {}
    for r in V.decision(spark, DATA).where("condition in ('clean', 'shift_time')").select("case_id", "condition", "correct").collect():
        per.setdefault(r.case_id, {})[r.condition] = r.correct
    d = [x["clean"] - x["shift_time"] for x in per.values()]
    n, plus, minus = sum(map(abs, d)), d.count(1), d.count(-1)
    tail = [math.comb(n, k) for k in range(n + 1) if abs(2 * k - n) >= abs(plus - minus)]
    got = QUERIES["b06_sign_flip"](spark, DATA).first()
    assert got["sum"] == plus - minus and got.p == pytest.approx(sum(tail) / 2**n)
    exact = QUERIES["b05_mcnemar"](spark, DATA).first()
    assert (exact.only_a, exact.only_b) == (plus, minus) and exact.p == pytest.approx(got.p, abs=1e-9)


def test_every_row_is_returned(spark):
    cases = V.scored(spark, DATA).select("case_id").distinct().count()
    for name in ("l08_agreement", "l09_replicate_stability", "a08_mid_percentile"):
        assert QUERIES[name](spark, DATA).select("case_id").distinct().count() == cases
    assert sum(r.row_count for r in QUERIES["w04_dense_windows"](spark, DATA).collect()) == V.flow(spark, DATA).count()
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn").distinct()
    assert QUERIES["l01_first_json"](spark, DATA).select("conv_id", "turn").distinct().count() == turns.count()


def test_mid_percentiles_by_counting(spark):
    rows = V.scored(spark, DATA).select("case_id", "fold", "score", "y").collect()
    got = {r.case_id: r.percentile for r in QUERIES["a08_mid_percentile"](spark, DATA).collect()}
    for r in rows[::7]:
        others = [x.score for x in rows if x.fold == r.fold and x.y == 0]
        assert got[r.case_id] == pytest.approx((sum(x < r.score for x in others) + sum(x == r.score for x in others) / 2) / len(others), abs=2e-9)


def test_tfidf_takes_all_languages(spark):
    words = spark.read.parquet(f"{DATA}/documents.parquet").where(r"text rlike '(?U)\\w\\w'").select("doc_id", "lang").collect()
    got = {r.doc_id for r in QUERIES["m06_tfidf"](spark, DATA).select("doc_id").distinct().collect()}
    assert {r.lang for r in words} == {r.lang for r in words if r.doc_id in got}
