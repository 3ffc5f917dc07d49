"""Disclosive words in all documents and at the ends of texts."""

import random

from spanlight.llm import pii

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(n))


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r.spans.split(",") for r in pii.report(df).collect()}, {r.doc_id: r.text for r in pii.sanitize(df, length=None).collect()}


def test_terms_go_where_no_entity_stands(spark):
    rows = [(i, f"{prose(30, i)} operator zorbax calls a{i}@mail.org today {prose(30, 100 + i)}") for i in range(6)]
    rows += [(50 + i, prose(60, 200 + i)) for i in range(40)] + [(99, f"{prose(20, 7)} zorbax {prose(20, 8)}"), (100, None)]
    spans, clean = found(spark, rows)
    at = dict(rows)[99].index("zorbax")
    assert spans[99] == [f"term:{at}:{at + 6}"] and "zorbax" not in clean[99] and "[TERM]" in clean[99]
    assert all(clean[i] == t for i, t in rows[6:46]) and clean[100] is None


def test_first_and_last_words_count(spark):
    rows = [(i, f"zorbax a{i}@mail.org {prose(30, i)} b{i}@mail.org quuxly") for i in range(5)]
    rows += [(50 + i, prose(60, 200 + i)) for i in range(40)]
    spans, clean = found(spark, rows)
    for i, text in rows[:5]:
        assert spans[i][0] == "term:0:6" and spans[i][-1] == f"term:{len(text) - 6}:{len(text)}"
        assert clean[i].startswith("[TERM] [EMAIL]") and clean[i].endswith("[EMAIL] [TERM]")


def test_copies_are_one_piece_of_evidence(spark):
    shouted = f"{prose(20, 1)} HETHON,!! NDHA!! 10.1.2.3 ARE!! {prose(20, 2)}"
    # Equal texts, and texts that differ far from the entity.
    rows = [(i, shouted) for i in range(8)] + [(20 + i, f"{shouted} {prose(5, 50 + i)}") for i in range(8)]
    rows += [(50 + i, prose(60, 200 + i)) for i in range(40)]
    spans, _ = found(spark, rows)
    assert not any(s.startswith("term") for v in spans.values() for s in v)


def test_words_are_folded(spark):
    rows = [(i, f"{prose(30, i)} {w} a{i}@mail.org {prose(30, 100 + i)}") for i, w in enumerate(("zorbax", "Zorbax,", "(ZORBAX)", "zorbax!!", "“Zorbax”", "ZorBax."))]
    rows += [(50 + i, prose(60, 200 + i)) for i in range(40)] + [(99, "*ZORBAX* there")]
    spans, clean = found(spark, rows)
    assert spans[99] == ["term:1:7"] and clean[99] == "*[TERM]* there" and all("zorbax" not in clean[i].lower() for i in range(6))


def test_words_found_elsewhere_as_well_stay(spark):
    rows = [(i, f"{prose(30, i)} common a{i}@mail.org {prose(30, 100 + i)}") for i in range(6)]
    rows += [(50 + i, f"{prose(30, 200 + i)} common {prose(30, 300 + i)}") for i in range(40)]
    spans, _ = found(spark, rows)
    assert not any("term" in s for v in spans.values() for s in v)
