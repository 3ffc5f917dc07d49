"""Texts that hold very many entities, and rows that share an id."""

import re
import time

from spanlight.llm import pii


def test_many_entities_in_one_text(spark):
    text = " ".join(f"word{i} 10.{i % 200}.{i // 200 % 200}.{i % 7} é" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "x a@b.co y")], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitize(df, length=None).collect()}
    assert time.time() - began < 90
    assert got[1].n_ip == 20_000 and got[3].n_email == 1 and got[2].spans == ""
    want = ",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"\d+\.\d+\.\d+\.\d+", text))
    assert ",".join(s for s in got[1].spans.split(",") if s.startswith("ip:")) == want
    assert clean[1].count("[IP]") == 20_000 and not re.search(r"\d+\.\d+\.\d+\.\d+", clean[1]) and clean[2] is None
    assert len(clean[1].split(" ")) == len(text.split(" "))


def test_cut_at_block_edges(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 8)
    rows = [(i, "é" * i + f" a@b.co 4111 1111 1111 1111 w{i}q 1.2.3.4 +49 123 456 789 end" + "x" * i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in pii.sanitize(df, length=None).collect():
        i = r.doc_id
        assert r.text == "é" * i + f" [EMAIL] [CARD] w{i}q [IP] [PHONE] end" + "x" * i, r.text
