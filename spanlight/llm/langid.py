"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of bytes, every window of every text; both directions read a window,
each letter position gets probabilities of the languages, and a document's probabilities are the
mean over all its letter positions. Training is backpropagation through time with Adam on a
bounded, documented sample of labelled windows (the same number of documents for each language);
scoring covers every byte and runs inside Arrow batches. The weights have a fixed size of a few
tens of kilobytes, which is what each task receives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.llm.common import documents, held_out, in_batches

WINDOW = 64
PAD = 256
#: Bytes whose windows are read together; bounds the memory of a task whatever a text's length.
BLOCK = 1 << 18
UNDETERMINED = "und"
#: Bytes at which a position is labelled: ASCII letters and all parts of multi-byte characters.
LETTERS = np.array([chr(b).isalpha() if b < 128 else b < 256 for b in range(257)])


@dataclass
class Gru:
    """Weights of one direction: a row of ``inputs`` for each byte, ``state`` for the recurrence."""

    inputs: np.ndarray
    state: np.ndarray

    def run(self, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step of ``ids`` (steps, windows)."""
        h_n = self.state.shape[0]
        h = np.zeros((ids.shape[1], h_n), np.float32)
        out = np.empty((*ids.shape, h_n), np.float32)
        for t, at in enumerate(ids):
            x, a = self.inputs[at], h @ self.state
            gates = np.tanh((x[:, : 2 * h_n] + a[:, : 2 * h_n]) * 0.5) * 0.5 + 0.5
            r, z, a_n = gates[:, :h_n], gates[:, h_n:], a[:, 2 * h_n :]
            n = np.tanh(x[:, 2 * h_n :] + r * a_n)
            if keep is not None:
                keep.append((h, r, z, a_n, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def back(self, ids: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``inputs`` and ``state`` from those of the states, last step first."""
        h_n = self.state.shape[0]
        d_h = np.zeros_like(keep[0][0])
        d_x = np.empty((*ids.shape, 3 * h_n), np.float32)
        d_state = np.zeros_like(self.state)
        for t in range(len(ids) - 1, -1, -1):
            h, r, z, a_n, n = keep[t]
            d_h = d_h + d_out[t]
            d_pre = d_h * (1 - z) * (1 - n * n)
            d_r, d_z = d_pre * a_n * r * (1 - r), d_h * (h - n) * z * (1 - z)
            d_x[t] = np.concatenate((d_r, d_z, d_pre), 1)
            d_a = np.concatenate((d_r, d_z, d_pre * r), 1)
            d_state += h.T @ d_a
            d_h = d_h * z + d_a @ self.state.T
        seen = np.zeros((ids.size, len(self.inputs)), np.float32)
        seen[np.arange(ids.size), ids.ravel()] = 1
        return seen.T @ d_x.reshape(-1, 3 * h_n), d_state


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Gru
    backward: Gru
    out: np.ndarray
    bias: np.ndarray
    losses: list[float] = field(default_factory=list)

    def positions(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position of ``ids`` (steps, windows)."""
        both = np.concatenate((self.forward.run(ids), self.backward.run(ids[::-1])[::-1]), 2)
        return softmax(both @ self.out + self.bias)

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the labelled positions of each text; zeros where there are none."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for owner, ids in windows(texts):
            letters = LETTERS[ids]
            p = np.where(letters[:, :, None], self.positions(ids), 0).sum(0, dtype=np.float64)
            np.add.at(sums, owner, p)
            np.add.at(counts, owner, letters.sum(0))
        return sums / np.maximum(counts, 1)[:, None]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of windows that cover every byte: the text each belongs to, and (step, window) ids."""
    owners, rows, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            part = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
            n = -(-len(part) // WINDOW)
            ids = np.full(n * WINDOW, PAD, np.int16)
            ids[: len(part)] = part
            owners.append(np.full(n, k))
            rows.append(ids.reshape(n, WINDOW))
            size += n * WINDOW
            if size >= BLOCK:
                yield np.concatenate(owners), np.ascontiguousarray(np.concatenate(rows).T)
                owners, rows, size = [], [], 0
    if rows:
        yield np.concatenate(owners), np.ascontiguousarray(np.concatenate(rows).T)


def train(texts: list[bytes], labels: list[str], hidden: int = 12, steps: int = 160, batch: int = 256, rate: float = 0.02, seed: int = 7) -> LanguageModel:
    """Fit the network on windows (at most ``WINDOW`` bytes each) by truncated backpropagation through time."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    ids = np.full((len(texts), WINDOW), PAD, np.int16)
    for k, text in enumerate(texts):
        ids[k, : len(text)] = np.frombuffer(text[:WINDOW], np.uint8)

    def weights(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.2).astype(np.float32)

    model = LanguageModel(languages, Gru(weights(257, 3 * hidden), weights(hidden, 3 * hidden)), Gru(weights(257, 3 * hidden), weights(hidden, 3 * hidden)), weights(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))
    params = [model.forward.inputs, model.forward.state, model.backward.inputs, model.backward.state, model.out, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(texts), batch)
        x = np.ascontiguousarray(ids[pick].T)
        weight = LETTERS[x].astype(np.float32)
        weight /= max(1.0, float(weight.sum()))
        kept_f: list = []
        kept_b: list = []
        both = np.concatenate((model.forward.run(x, kept_f), model.backward.run(x[::-1], kept_b)[::-1]), 2)
        p = softmax(both @ model.out + model.bias)
        at = np.ix_(range(WINDOW), range(batch))
        model.losses.append(float(-(np.log(p[(*at, y[pick][None, :])] + 1e-9) * weight).sum()))
        p[(*at, y[pick][None, :])] -= 1
        d_logits = p * weight[:, :, None]
        d_both = d_logits @ model.out.T
        grads = [
            *model.forward.back(x, kept_f, d_both[:, :, :hidden]),
            *model.backward.back(x[::-1], kept_b, d_both[::-1, :, hidden:]),
            both.reshape(-1, 2 * hidden).T @ d_logits.reshape(-1, len(languages)),
            d_logits.sum((0, 1)),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p_, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def training_windows(docs: DataFrame, id: str, text: str, lang: str, per_language: int, per_document: int, max_languages: int) -> DataFrame:
    """``(label, piece)``: windows at hashed places of a hashed sample of at most ``per_language`` documents a language."""
    labelled = docs.where(~held_out(id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(id).alias("id"), F.col(lang).cast("string").alias("label"), F.col(text).alias("text")
    )
    share = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_languages).select("label", (F.lit(1.5 * per_language) / F.col("count")).alias("share"))
    draw = F.xxhash64(F.lit("sample"), "id")
    drawn = labelled.join(F.broadcast(share), "label").where(F.pmod(draw, F.lit(1 << 24)) / (1 << 24) < F.col("share"))
    kept = drawn.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(draw, "id"))).where(F.col("n") <= per_language)
    place = F.pmod(F.xxhash64("id", "k"), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int")
    return kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_document)))).select("label", F.substr("text", place + 1, F.lit(WINDOW)).alias("piece"))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600, per_document: int = 4, max_languages: int = 200) -> LanguageModel | None:
    """Fit on at most ``per_language * per_document`` windows for each of the ``max_languages`` commonest labels; None without labels."""
    rows = training_windows(docs, id, text, lang, per_language, per_document, max_languages).orderBy("label", "piece").collect()
    if not rows:
        return None
    return train([r.piece.encode() for r in rows], [r.label for r in rows])


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` without ``text``, with the likeliest language and its pooled probability.

    Null texts and texts without a letter get ``und`` and score 0, as does every text if no
    model could be learned. Whole texts are read; columns named like the results are replaced.
    """
    rest = [c for c in docs.columns if c not in (text, pred, score)]
    kept = docs.select(*rest, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model is not None:
                pooled = model.pool([t or b"" for t in texts])
                best = pooled.argmax(1)
                scores = np.clip(pooled[np.arange(len(texts)), best], 0, 1)
                names = [UNDETERMINED if t is None else model.languages[b] for t, b in zip(texts, best, strict=True)]
                scores[[t is None for t in texts]] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], [*rest, pred, score])

    return in_batches(kept).mapInArrow(run, docs.select(*rest, F.lit("").alias(pred), F.lit(0.0).alias(score)).schema)


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score`` for every document; rows are learned from only outside the held-out fifth."""
    model = fit(docs, id, text, lang)
    return predict(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), model).select(F.col("doc_id").alias(id), held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has letters and one language with a pooled probability of ``least`` or more.

    Null texts and texts without a letter go. All columns stay as they are, whatever their names
    and nulls; repeated rows are decided alike; where no label can be learned from, or only one,
    having letters is enough; an empty table stays empty. Rows are filtered where they lie, in the
    Arrow batches that bring them, without a shuffle and without a second copy of the text.
    """
    model = fit(docs, id, text, lang)
    lettered, at = docs.where(F.col(text).rlike(r"\p{L}")), docs.columns.index(text)
    if model is None or len(model.languages) == 1:
        return lettered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = model.pool(batch.column(at).cast(pa.binary()).to_pylist()).max(1, initial=0)
            yield batch.filter(pa.array(best >= least))

    return in_batches(lettered).mapInArrow(run, docs.schema)


def op9_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
