"""The drawn mixture against its targets."""

import pytest
from pyspark.sql import functions as F
from spanlight.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    # One source holds nearly everything; rare ones have weights far above 1 / budget.
    rows = [(i, f"word{i} and more", "en" if i % 3 else "de", "rare" if i % 100 == 0 else "some" if i % 11 == 0 else "large") for i in range(6000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def shares(df, by):
    total = df.agg(F.sum(mixing.tokens_of(F.col("text")))).first()[0]
    return {r[0]: r[1] / total for r in df.groupBy(by).agg(F.sum(mixing.tokens_of(F.col("text")))).collect()}


def test_sample_meets_tempered_targets(docs):
    seen = shares(docs, "source")
    whole = sum(x**0.5 for x in seen.values())
    got = mixing.sample_mixture(docs, copies=100)  # no bound in reach
    assert got.columns == docs.columns
    for k, v in shares(got, "source").items():
        assert v == pytest.approx(seen[k] ** 0.5 / whole, abs=0.02)
    assert got.count() == pytest.approx(0.6 * docs.count(), rel=0.05)


def test_sample_meets_given_targets(spark, docs):
    targets = spark.createDataFrame([("source", "rare", 2.0), ("source", "large", 2.0), ("lang", "de", 3.0), ("lang", "en", 1.0)], "dim string, value string, weight double")
    got = mixing.sample_mixture(docs, targets=targets, copies=100)
    assert shares(got, "source") == pytest.approx({"rare": 0.5, "large": 0.5}, abs=0.03)
    assert shares(got, "lang") == pytest.approx({"de": 0.75, "en": 0.25}, abs=0.03)


def test_expected_tokens_meet_all_targets(spark, docs):
    keyed, names = mixing.describe(docs)
    out = mixing.calibrate(keyed, names, copies=100).withColumn("expected", F.col(names["weight"]) * F.col(names["tokens"]))
    total = out.agg(F.sum("expected")).first()[0]
    for dim in ("source", "lang"):
        seen = {r[0]: r[1] for r in keyed.groupBy(dim).agg(F.sum(names["tokens"])).collect()}
        whole, half = sum(seen.values()), sum((x / sum(seen.values())) ** 0.5 for x in seen.values())
        for r in out.groupBy(dim).agg(F.sum("expected")).collect():
            assert r[1] / total == pytest.approx((seen[r[0]] / whole) ** 0.5 / half, abs=1e-5)


def test_bounded_copies(spark, docs):
    """No document comes more than twice; a target beyond that is cut to what its value can give, and the others are met."""
    keyed, names = mixing.describe(docs)
    got = {(r.dim, *r.value): r for r in mixing.marginals(mixing.rake(mixing.cells_of(keyed, names))).collect()}
    seen = shares(docs, "source")
    rare = got["source", "rare"]
    assert rare.wanted > 2 / 0.6 * seen["rare"] and rare.target == pytest.approx(2 / 0.6 * seen["rare"])
    assert sum(r.target for k, r in got.items() if k[0] == "source") == pytest.approx(1)
    assert got["source", "large"].target / got["source", "some"].target == pytest.approx((seen["large"] / seen["some"]) ** 0.5)
    assert all(r.reached == pytest.approx(r.target, abs=1e-6) for r in got.values())
    out = mixing.calibrate(keyed, names)
    assert out.agg(F.max(names["copies"])).first()[0] == 2
    assert mixing.sample_mixture(docs).groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    once = mixing.sample_mixture(docs, copies=1)
    assert once.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 1


def test_targets_on_given_tables(spark):
    """On a table of four languages with topics of their own, all targets are met within 0.002."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keyed, names = mixing.describe(docs)
    m = mixing.marginals(mixing.rake(mixing.cells_of(keyed, names))).toPandas()
    seen = shares(docs.na.fill("", ["lang"]), "lang")
    whole = sum(v**0.5 for v in seen.values())
    reached = {r.value[0]: r.reached for r in m[m.dim == "lang"].itertuples()}
    assert all(abs(reached[k] - v**0.5 / whole) < 0.002 for k, v in seen.items())
    assert ((m.reached - m.target).abs() < 0.002).all()
    assert len({tuple(v) for v in m[m.dim == "topic"].value}) > 30


def test_topics_are_anchor_words(spark):
    rows = [(i, "filler filler " + ("apple apple pears" if i % 13 == 0 else "pears stone stone" if i % 17 == 0 else "nothing"), "en") for i in range(400)] + [(900, None, "en"), (901, "", "en"), (902, "apple " * 50_000, "en")]
    rows += [(1000 + i, "слово слово " + ("камень" if i % 15 == 0 else "apple"), "ru") for i in range(60)] + [(1100, "камень apple", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    anchors = mixing.anchor_words(df)
    assert anchors == {"en": ["apple", "stone"], "ru": ["камень"]}
    language = F.coalesce("lang", F.lit(""))
    got = {r.doc_id: r.t for r in df.select("doc_id", mixing.topic_of(F.col("text"), language, anchors).alias("t")).collect()}
    assert got[0] == got[902] == "apple" and got[17] == "stone" and got[1] == got[900] == got[901] == "other"
    assert got[1000] == "камень" and got[1001] == got[1100] == "other"  # another language's anchor is no topic
    assert mixing.anchor_words(df, languages=1).keys() == {"en"}


def test_words_are_parted_by_single_spaces_only(spark):
    texts = ["abcd abcd  wxyz", "abcd", "abcd\nabcd abcd\n", "xabcd abcdx Abcd", "wxyz abcd", " abcd wxyz wxyz ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", mixing.topic_of(F.col("text"), F.lit("x"), {"x": ["wxyz", "abcd"]}).alias("t")).collect()}
    for k, t in enumerate(texts):
        words = (t or "").split(" ")
        want = max((words.count(a), -i, a) for i, a in enumerate(["wxyz", "abcd"]))
        assert got[k] == (want[2] if want[0] else "other")
    words = {r.doc_id: r.w for r in df.select("doc_id", mixing._content(F.col("text")).alias("w")).collect()}
    for k, t in enumerate(texts):
        assert words[k] == [w for w in (t or "").split(" ") if len(w) >= 4 and w.isalpha()]


def test_the_gap_of_a_small_table_is_observed_where_it_is_written(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", "t", 5), ("a", "y", "u", 30), ("b", "x", "u", 1), (None, "y", None, 400), ("c", None, "t", 7)], "source string, lang string, topic string, tokens bigint")
    dims = {"source": ["source"], "lang": ["lang"]}
    once = mixing.rake(cells, dims, most=1).drop("factor")
    stored, gap = mixing._swept(once.coalesce(1), dims)
    assert stored.columns == once.columns and stored.count() == 5
    assert gap > mixing.CLOSE and gap == pytest.approx(mixing.largest_gap(stored, dims), rel=1e-9)
    empty, none = mixing._swept(once.where("tokens < 0").coalesce(1), dims)
    assert empty.count() == 0 and none == 0.0
    with monkeypatch.context() as m:
        m.setattr(mixing, "largest_gap", lambda *args: 1 / 0)
        raked = mixing.rake(cells, dims)
        assert raked.count() == 5
