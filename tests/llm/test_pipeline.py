"""The pipeline's stages against their own input."""

import corpus_pipeline
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    base = "in this small corpus every word of the text is plain and common enough to read".split()
    rows = []
    for i in range(60):
        text = " ".join(base[(i * 7 + j * (i % 5 + 1)) % len(base)] + str((i * j) % 11) for j in range(40))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(100, rows[3][1], "en", "s0", 1), (101, "123 456", "en", "s0", 7), (102, None, None, None, None), (103, rows[5][1] + " me@mail.org", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.collect()}
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "personal_data":
            assert docs.where(F.col("text").contains("@")).count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).where("text like '%[EMAIL]%'").count() == 0
    assert seen["language"] == set(range(60)) | {100, 103}
    assert 100 not in seen["near_duplicates"] and seen["near_duplicates"] == seen["personal_data"]
    assert seen["mixing"] < seen["personal_data"] and seen["packing"] == seen["mixing"]
