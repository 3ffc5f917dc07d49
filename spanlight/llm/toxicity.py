"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled sample is drawn from all documents of
the training folds, toxic ones included, as the estimator asks for. With the class prior p and a loss l(y, f), the risk of a linear scorer f is

    p * E_P[l(+1, f)] + max(0, E_U[l(-1, f)] - p * E_P[l(-1, f)])

where the maximum keeps the estimated risk of the negatives from going below zero (if it does,
the step goes the other way instead, as in Kiryo et al. 2017). The scorer is trained in numpy by
proximal gradient steps with the logistic loss; an L1 term leaves weights only on words that
carry evidence, so a long clean text does not add up noise. Features are the distinct words of a
whole text and their beginnings. Training uses a bounded hashed sample; the prior is estimated over all labels of the
training folds, and scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm.common import documents, held_out, in_batches, materialize

#: Bytes that part words: everything in ASCII but letters, digits and the apostrophe; capitals become small.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() or b == 39 else b + 32 if chr(b).isupper() else 32 for b in range(256))


#: Beginnings of words, in bytes, that are features beside whole words; they carry over to words not seen.
HEADS = (5, 6, 7)


def features(text: bytes) -> set[bytes]:
    """The distinct words of a text, and their beginnings after a ``^``."""
    words = set(text.translate(_TABLE).split())
    heads = {w[:n] for n in HEADS for w in words if len(w) > n}
    return words | {b"^" + x for x in heads}


@dataclass
class Scorer:
    weights: dict[bytes, float]
    bias: float
    prior: float
    risks: list[float] = field(default_factory=list)

    def score(self, text: bytes) -> float:
        """Estimated probability that a text is toxic; depends on its words alone."""
        weights = self.weights
        f = self.bias + sum(weights[w] for w in sorted(weights.keys() & features(text)))
        return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


def train(rows: list[tuple[np.ndarray, bool]], words: list[bytes], prior: float, steps: int = 800, rate: float = 0.25, l1: float | None = None) -> Scorer:
    """Fit on ``(indices of words, is positive)`` rows with the non-negative risk estimator.

    ``l1`` is by default what the gradient of a word without evidence, in a twentieth of the
    positives, varies by; so a small sample admits fewer words.
    """
    size = np.array([len(r[0]) for r in rows])
    owner, column = np.repeat(np.arange(len(rows)), size), np.concatenate([r[0] for r in rows])
    positive = np.array([r[1] for r in rows])
    l1 = l1 or max(4e-4, prior * float(np.sqrt(0.05 / max(1, positive.sum()))))
    in_p, in_u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    w, bias, risks = np.zeros(len(words)), float(np.log(prior / (1 - prior))), []
    first, second = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        f = np.bincount(owner, w[column], len(rows)) + bias
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        as_negative, as_positive = np.logaddexp(0, f), np.logaddexp(0, -f)
        negative_risk = float(in_u @ as_negative - prior * (in_p @ as_negative))
        risks.append(prior * float(in_p @ as_positive) + max(0.0, negative_risk))
        on_negative = (in_u - prior * in_p) * p
        g = on_negative - prior * in_p * (1 - p) if negative_risk >= 0 else -on_negative
        grad = np.append(np.bincount(column, g[owner], len(words)), g.sum())
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        move = rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-5)
        w, bias = w - move[:-1] * 0.2, bias - move[-1] * 0.02
        # Proximal step: shrink towards zero by what the scaled step size allows.
        shrink = l1 * rate * 0.2 * (1 - step / (steps + 1)) / (np.sqrt(second[:-1] / (1 - 0.99**step)) + 1e-5)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    kept = np.flatnonzero(w)
    return Scorer({words[i]: float(w[i]) for i in kept}, bias, prior, risks)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", positives: int = 4000, unlabelled: int = 8000, vocabulary: int = 20_000, least: int = 3) -> Scorer | None:
    """Fit on at most ``positives`` toxic documents and ``unlabelled`` ones of any label outside the held-out fifth.

    Both samples are the first ids in hash order, one text for each id, so repeated rows and ids of
    many rows do not exceed the bounds. An id is toxic if one of its labels says so; labels without
    an id, null labels and rows without an id are not learned from; null texts count as empty;
    other columns are ignored, whatever their names. The vocabulary is the ``vocabulary`` words
    with the largest gap between their document frequencies in the two samples, out of those in at
    least ``least`` positives. Without a positive or any document there is nothing to learn, as
    with empty tables, and the result is None.
    """
    marks = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("label_id")).agg(F.max(toxic).alias("label_toxic"))
    training = docs.where(~held_out(id)).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = training.select("id").distinct().join(marks, F.col("id") == F.col("label_id"), "left").select("id", (F.coalesce("label_toxic", F.lit(0)) == 1).alias("toxic"), F.col("label_toxic").isNotNull().alias("labelled"))
    joined = materialize(joined)
    total = joined.agg(F.count_if("toxic").alias("p"), F.count("*").alias("u"), F.count_if("labelled").alias("l")).first()
    if not total.p or not total.u:
        return None
    prior = min(0.9, max(1e-4, total.p / total.l))
    order = (F.xxhash64(F.lit("pu"), "id"), F.col("id"))
    drawn = joined.where("toxic").orderBy(*order).limit(positives).select(F.col("id").alias("drawn_id"), F.lit(True).alias("positive"))
    drawn = materialize(drawn.union(joined.orderBy(*order).limit(unlabelled).select("id", F.lit(False))))
    # The draw has at most ``positives + unlabelled`` ids, so they are sent to the texts and not the other way.
    sample = training.join(F.broadcast(drawn), F.col("id") == F.col("drawn_id")).groupBy("id", "positive").agg(F.min("text").alias("text")).select("id", "text", "positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(features(t.as_py())) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.binary()))], ["id", "positive", "words"])

    listed = in_batches(sample).mapInArrow(run, "id bigint, positive boolean, words array<binary>")
    counts = listed.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).where(F.col("p") >= least)
    gap = F.abs(F.col("p") / F.lit(float(min(total.p, positives))) - F.col("u") / F.lit(float(min(total.u, unlabelled))))
    words = sorted(bytes(r.word) for r in counts.orderBy(F.desc(gap), "word").limit(vocabulary).select("word").collect())
    index = {w: i for i, w in enumerate(words)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(sorted(index[w] for w in index.keys() & features(t.as_py())), np.int32).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "positive", "words"])

    rows = in_batches(sample).mapInArrow(number, "id bigint, positive boolean, words binary").orderBy("id", "positive").collect()
    return train([(np.frombuffer(r.words, np.int32), r.positive) for r in rows], words, prior)


def score(docs: DataFrame, scorer: Scorer | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without ``text`` and with its score.

    Null and empty texts get the score of no words, without a scorer all get 0; repeated rows and
    equal texts get equal scores; whole texts count, however long; a column named like ``out`` is
    replaced; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            found = [scorer.score(t.as_py() or b"") if scorer else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*rest, out])

    return in_batches(docs).select(*rest, text).mapInArrow(run, docs.select(*rest, F.lit(0.0).alias(out)).schema)


def op1_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
