"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint x links to y if they differ in at most three bits. Then some value v lies within
one bit of one of them and within two bits of the other, so it is enough that every fingerprint
posts the values of its ball and that postings meet on equal values:

* within one bit: x itself and its 64 single flips;
* within two bits: the values reached by setting two bits that are 0 in x. Of three differing
  bits, two are 0 on one of the two sides, so that side reaches the meeting point this way, and
  half of the 2,016 double flips need not be posted.

Whoever stands within one bit of v links to all that stand within two bits of it, by the
triangle inequality. So a value needs a star around its smallest one-bit member, never the pairs
of its members, and a group of any size costs as many edges as it has postings. Fingerprints are
distinct when they post; at most 2,081 of them can meet on one value.

561 postings for each fingerprint are many, and most fingerprints have no partner at all.
Therefore a cheaper ball comes first: if two fingerprints differ in three bits, one of their
32-bit halves differs in at most one, and that half of one side is the half of the other with
one 0 bit set. Half values are counted by their smallest and largest poster (a partial
aggregation), and only fingerprints that meet another one there post their full balls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm.common import documents, in_batches, materialize
from spanlight.llm.components import connected_components

SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every shingle of ``n`` words, repeats included; all words of a shorter text are one shingle."""
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))[: max(1, len(words) - n + 1)]
    stops = stops[n - 1 :] if len(words) >= n else stops[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that more than half of the hashes have; 0 without a hash."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of a UTF-8 text; repeats count, no words give zero."""
    return majority(shingle_hashes(text.lower().split(), shingle))


def add_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """``docs`` without its text and with a signed 64-bit fingerprint; null text counts as empty."""
    kept = docs.select([c for c in docs.columns if c not in (text, out)] + [F.coalesce(F.col(text), F.lit("")).alias(text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), "<u8", len(texts)).view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], [*batch.schema.names[:-1], out])

    return in_batches(kept).mapInArrow(run, kept.drop(text).withColumn(out, F.lit(0).cast("bigint")).schema)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` over all tasks: a few small rows of a table are about to become many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _half_postings(prints: DataFrame) -> DataFrame:
    """``(half, value, fp, exact)``: either half of each fingerprint, and that half with one 0 bit set."""
    halves = F.array(
        *(F.struct(F.lit(h).alias("half"), F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")) for h in (0, 1))
    )
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), _bit), lambda b: F.col("h.v").bitwiseAND(b) == 0)
    return (
        prints.select("fp", F.explode(halves).alias("h"))
        .select("fp", F.col("h.half").alias("half"), F.col("h.v").alias("v"), F.explode(F.concat(F.array(F.lit(0).cast("bigint")), flips)).alias("b"))
        .select("fp", "half", F.col("v").bitwiseOR(F.col("b")).alias("value"), (F.col("b") == 0).alias("exact"))
    )


def candidates(prints: DataFrame) -> DataFrame:
    """The fingerprints ``fp`` that have another one in reach of their halves' balls; no partner within three bits is lost."""
    posted = _half_postings(prints)
    met = (
        posted.groupBy("half", "value")
        .agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bool_or("exact").alias("hit"))
        .where("hit and lo <> hi")
        .select("half", "value")
    )
    return posted.join(met, ["half", "value"], "left_semi").select("fp").distinct()


def linked(classes: DataFrame) -> DataFrame:
    """Star edges ``a, b`` of the distinct fingerprints ``fp``: the cheap ball first, then the full balls of those that met."""
    return links(_dealt(materialize(candidates(_dealt(classes.select("fp"))))))


def links(prints: DataFrame) -> DataFrame:
    """Star edges ``a, b`` among distinct fingerprints ``fp`` that connect all pairs within three bits."""
    bits = F.sequence(F.lit(0), F.lit(63))
    near = F.transform(
        F.concat(F.array(F.lit(0).cast("bigint")), F.transform(bits, _bit)),
        lambda b: F.struct(F.col("fp").bitwiseXOR(b).alias("v"), F.lit(True).alias("near")),
    )
    zeros = F.filter(F.transform(bits, _bit), lambda b: F.col("fp").bitwiseAND(b) == 0)
    pairs = F.flatten(
        F.transform(F.col("zeros"), lambda b, i: F.transform(F.slice("zeros", i + 2, F.greatest(F.size("zeros") - i - 1, F.lit(0))), lambda c: b.bitwiseOR(c)))
    )
    far = F.transform(F.col("pairs"), lambda b: F.struct(F.col("fp").bitwiseOR(b).alias("v"), F.lit(False).alias("near")))
    posted = (
        prints.select("fp", zeros.alias("zeros"))
        .select("fp", pairs.alias("pairs"))
        .select("fp", F.explode(F.concat(near, far)).alias("p"))
        .select("fp", "p.v", "p.near")
    )
    star = F.min(F.when(F.col("near"), F.col("fp")))
    return (
        posted.groupBy("v")
        .agg(star.alias("a"), F.collect_set("fp").alias("members"))
        .where("a is not null and size(members) > 1")
        .select("a", F.explode("members").alias("b"))
        .where("a <> b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Group the documents whose fingerprints are connected by steps of at most three bits.

    Returns one row for each document: its id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id of its group. Null and empty texts have fingerprint zero
    and are linked like others; equal texts always share a group; other columns are ignored;
    an empty table gives an empty result. Rows without an id are dropped.
    """
    prints = materialize(add_fingerprints(docs.where(F.col(id).isNotNull()).select(F.col(id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle))
    classes = materialize(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    roots = connected_components(linked(classes))
    group = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Few classes share a root with others; the rest keep their own smallest id.
    lowest = group.groupBy("root").agg(F.min("first").alias("component_id"))
    named = group.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, prints.fingerprint == named.fp).select(
        F.col("doc_id").alias(id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
