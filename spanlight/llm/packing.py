"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best-fit. All pieces of one length are interchangeable, and so are all sequences
with one gap, so a sweep matches runs: a run of ranks within a length, a run of sequence numbers
with one gap. Sweeps take the longest lengths first, down to half of the longest one left:

1. Lengths and gaps are sorted by size together. The lengths between two neighbouring gaps have
   the same successor, the smallest gap that holds them, and the gaps between two neighbouring
   lengths have the same predecessor; such a stretch of lengths and of gaps is a zone.
2. Inside a zone longer pieces rank before shorter ones and smaller gaps before larger ones. Sums
   along both orders, in sequences, say which run of pieces takes which run of gaps: two runs meet
   where their intervals overlap, so no two pieces claim one place.
3. Runs are split, gaps shrink, and the next sweep follows until no piece is left. Where no gap
   holds a length, as many sequences as its tokens need are opened.

Sweeps are DataFrame operations over runs. There are at most ``capacity`` lengths and gaps, so a
sweep's tables have a bound that does not depend on the number of documents and one task makes a
sweep. What grows with the corpus is distributed: the histogram of lengths is one aggregation, ranks
come from a count by (length, block), and one join by length and rank places every piece.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.llm.common import documents, in_batches, materialize
from spanlight.llm.tokens import word_encoder

CAPACITY = 2048
END = 0


def tokenize(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, slot`` of every piece; longer documents are cut every ``capacity`` ids.

    ``slot`` is a document's place in its batch; it tells repeated rows apart where pieces are dealt to tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = word_encoder(folder).encode, 4 * capacity
        for batch in batches:
            owner, piece, length, crc = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t or "") + end.to_bytes(4, "little")
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    owner.append(k)
                    piece.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            pieces = pa.array(piece, pa.int32())
            starts = pa.compute.multiply(pieces.cast(pa.int64()), capacity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int32())), pieces, starts, pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(owner, pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "slot"],
            )

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, slot int")


#: Rows of the sweeps' table: lengths with pieces left, sequences with a gap, and what was placed.
LENGTH, GAP, FLOW = 0, 1, 2
#: Lengths up to this one are taken together in the last sweeps.
SHORT = 128


def _one_row(spark: SparkSession, **values: int) -> DataFrame:
    """A local table of one row of whole numbers, which no task has to make."""
    return spark.sql(f"SELECT * FROM VALUES ({', '.join(f'{v}L' for v in values.values())}) AS one({', '.join(values)})")


def _zones(state: DataFrame) -> DataFrame:
    """``state`` with the zone of each row and the run of sequences it wants or offers there, ``fro`` to ``to``; ``other`` is what the other kind has in all.

    ``per`` pieces of a length go to a sequence of its zone; it is null where no gap holds the length. Lengths up to half of
    the longest one wait (``idle``): they are a zone of their own, in which nothing is offered.
    """
    longest = F.max(F.when(F.col("kind") == LENGTH, F.col("size"))).over(Window.partitionBy())
    above = F.when(longest > SHORT, F.floor(longest / 2)).otherwise(0)
    sorted_, zone = Window.partitionBy("idle").orderBy("size", "kind", "first"), Window.partitionBy("idle", "zone")
    chosen = state.select("kind", "size", "first", "n", ((F.col("kind") == LENGTH) & (F.col("size") <= above)).alias("idle"))
    opens = ((F.col("kind") == LENGTH) & F.coalesce(F.lag("kind").over(sorted_) == GAP, F.lit(True))).cast("int")
    out = chosen.withColumn("opens", opens).withColumn("zone", F.sum("opens").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.min(F.when(F.col("kind") == GAP, F.col("size"))).over(zone)
    out = out.withColumn("per", F.when(F.col("kind") == LENGTH, F.floor(least / F.col("size"))))
    out = out.withColumn("units", F.when(F.col("kind") == GAP, F.col("n")).otherwise(F.coalesce(F.ceil(F.col("n") / F.col("per")), F.lit(0))))
    ranks = Window.partitionBy("idle", "zone", "kind").orderBy(F.when(F.col("kind") == GAP, F.col("size")).otherwise(-F.col("size")), "first")
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("units"))).over(zone), F.lit(0))
    other = F.when(F.col("kind") == GAP, total(LENGTH)).otherwise(total(GAP))
    return out.withColumn("to", F.sum("units").over(ranks)).withColumn("other", other).withColumn("fro", F.col("to") - F.col("units")).drop("opens")


def sweep(state: DataFrame, capacity: int) -> DataFrame:
    """The table after one sweep over the lengths greater than half of the longest one, and the flows it made.

    A flow says: ``n`` pieces of length ``size`` from rank ``first`` on go ``per`` to a sequence, from
    ``sequence`` on, and the first one of a sequence lies at ``at``.

    Runs of lengths and runs of gaps both tile a zone from 0 on, so from one start of either kind to the next one run
    of each lies there: the last that began. No join is needed, and a sweep is windows over one table.
    """
    zoned = _zones(state)
    met_units = F.greatest(F.lit(0), F.least("units", F.col("other") - F.col("fro")))
    taken = F.when(F.col("kind") == GAP, met_units).otherwise(F.least("n", met_units * F.coalesce("per", F.lit(0))))
    zero = F.lit(0).cast("bigint")

    starts = Window.partitionBy("idle", "zone").orderBy("fro", "kind")
    so_far = starts.rowsBetween(Window.unboundedPreceding, 0)
    begun = lambda kind: F.last(F.when(F.col("kind") == kind, F.struct("fro", "to", "per", "size", "first", "n")), ignorenulls=True).over(so_far)
    met = zoned.withColumns({"taken": taken, "x": begun(LENGTH), "y": begun(GAP), "next": F.lead("fro").over(starts)})
    per, size, gap, o = F.col("x.per"), F.col("x.size"), F.col("y.size"), F.col("fro")
    until = F.least("x.to", "y.to", F.coalesce("next", "x.to"))
    met = met.withColumn("skip", (o - F.col("x.fro")) * per).withColumn("pieces", F.when(until > o, F.least((until - o) * per, F.col("x.n") - F.col("skip"))).otherwise(0))
    met = met.withColumn("pieces", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("pieces")))
    met = met.withColumn("sequence", F.col("y.first") + o - F.col("y.fro")).withColumn("full", F.floor(F.col("pieces") / per)).withColumn("odd", F.col("pieces") % per)

    def row(kind: int | Column, size: Column, first: Column, n: Column, per: Column = zero, sequence: Column = zero, at: Column = zero) -> Column:
        named = zip((size, first, n, per, sequence, at), ("size", "first", "n", "per", "sequence", "at"), strict=True)
        return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), *(c.cast("bigint").alias(name) for c, name in named))

    left = row(F.col("kind"), F.col("size"), F.col("first") + F.col("taken"), F.col("n") - F.col("taken"))
    flow = row(FLOW, size, F.col("x.first") + F.col("skip"), F.col("pieces"), per, F.col("sequence"), F.lit(capacity) - gap)
    shrunk = row(GAP, gap - per * size, F.col("sequence"), F.col("full"))
    last = row(GAP, gap - F.col("odd") * size, F.col("sequence") + F.col("full"), F.least(F.col("odd"), F.lit(1)))
    return met.select(F.explode(F.array(left, flow, shrunk, last)).alias("r")).select("r.*").where("n > 0 and size > 0")


def _sizes() -> list[Column]:
    """The longest length that has pieces left and the largest gap."""
    size = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("n") > 0), F.col("size")))
    return [size(LENGTH).alias("longest"), F.coalesce(size(GAP), F.lit(0)).alias("largest")]


def _stored(state: DataFrame) -> tuple[DataFrame, int | None, int]:
    """The sweeps' table as one file, with its longest length and largest gap.

    Both are observed by the task that writes the file, so they cost no job; they are maxima, which a repeated task leaves as they are.
    """
    seen = Observation()
    stored = materialize(state.coalesce(1).observe(seen, *_sizes()))
    return stored, seen.get.get("longest"), seen.get.get("largest") or 0


@contextlib.contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Inside, queries are planned once, as a whole: on tables of a few thousand rows a plan for each exchange costs the driver threads and memory."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sweeps(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``length, first, n, per, sequence, at`` of all flows that place ``counts`` (``length, n``; lengths are 1 to ``capacity``)."""
    with planned_once(counts.sparkSession):
        return _sweeps(counts, capacity)


def _sweeps(counts: DataFrame, capacity: int) -> DataFrame:
    spark = counts.sparkSession
    zero = F.lit(0).cast("bigint")
    state = counts.select(F.lit(LENGTH).alias("kind"), F.col("length").alias("size"), zero.alias("first"), "n", zero.alias("per"), zero.alias("sequence"), zero.alias("at"))
    state, longest, largest = _stored(state)
    tokens, flows, created = state.agg(F.sum(F.col("size") * F.col("n"))).first()[0], [], 0
    while longest is not None:
        # Numbers that differ from sweep to sweep come as rows, so that one compiled plan serves all sweeps.
        above = longest // 2 if longest > SHORT else 0
        opened = 0
        if not created:
            opened = -(-tokens // capacity)
        elif longest > largest:
            unfit = state.where(F.col("kind") == LENGTH).crossJoin(F.broadcast(_one_row(spark, most=max(above, largest)))).where("size > most")
            opened = -(-unfit.agg(F.sum(F.col("size") * F.col("n"))).first()[0] // capacity)
        new = _one_row(spark, kind=GAP, size=capacity, first=created, n=opened, per=0, sequence=0, at=0).withColumn("kind", F.col("kind").cast("int"))
        created += opened
        state, longest, largest = _stored(sweep(state.union(new).where("n > 0").coalesce(1), capacity))
        flows += state.inputFiles()
        state = state.where(F.col("kind") != FLOW)
    # One scan of all sweeps' files, not one for each sweep.
    every = spark.read.schema(state.schema).parquet(*flows) if flows else state
    return every.where(F.col("kind") == FLOW).select(F.col("size").alias("length"), "first", "n", "per", "sequence", "at")


#: Flows up to this number (about 50 bytes each) are broadcast.
BROADCAST_FLOWS = 500_000


def ranked(pieces: DataFrame, total: int, block_rows: int = 200_000) -> DataFrame:
    """``pieces`` with ``rank``, from 0 among those of their length.

    Ranks come in blocks by hash, so a length that very many pieces share is counted by many tasks.
    """
    blocks = max(16, total // block_rows)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(*pieces.columns), F.lit(blocks)))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("inside", inside).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inside")).drop("block", "before", "inside")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a ``length`` of 1 to ``capacity`` each) with ``sequence_id`` and ``offset``."""
    counts = materialize(pieces.groupBy("length").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    flows = sweeps(counts, capacity).withColumnsRenamed({"first": "first_rank", "n": "many"})
    nth = F.col("rank") - F.col("first_rank")
    return (
        ranked(pieces, total)
        .join(F.broadcast(flows) if flows.count() <= BROADCAST_FLOWS else flows, "length")
        .where("rank >= first_rank and rank < first_rank + many")
        .withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("per")))
        .withColumn("offset", F.col("at") + nth % F.col("per") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document, with its sequence and place.

    Null and empty texts are one piece that holds the end id alone; repeated rows are packed as
    often as they come; other columns are ignored; an empty table gives an empty result.
    """
    return place(materialize(tokenize(docs, id, text, capacity)), capacity).drop("slot").withColumnRenamed("doc_id", id)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
