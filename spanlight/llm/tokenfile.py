"""Token-id files: shared zstandard dictionary, one frame for each document, offset index.

A shard holds the documents of one range of ids in ascending order::

    magic "SPTK", version and id width (1 byte each), 2 zero bytes
    32 bytes     SHA-256 of the shared dictionary
    frames       the ids of each document, little-endian, one zstandard frame each
    index        for each document: id (8 bytes), offset of its frame (8), number of ids (8)
    footer       offset of the index (8), number of documents (8)

The dictionary lies beside the shards as ``dictionary-<hash>``, and ``manifest.json`` lists the
shards in order. A short document is read with one frame and no neighbour.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm.common import documents, in_batches, shared_dir
from spanlight.llm.tokens import byte_encoder

END = 2
MAGIC = b"SPTK\x01"
ENTRY = np.dtype([("id", "<i8"), ("at", "<i8"), ("ids", "<i8")])
DICTIONARY_BYTES = 1 << 16


def serialize(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids as ids of ``width`` bytes; ids that do not fit are an error."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >> 8 * width:
        raise ValueError(f"an id of {int(wide.max())} does not fit in {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, id: str, text: str, width: int, sample: int = 1500, most: int = 1 << 15) -> bytes:
    """A dictionary for the ids of a hashed sample: about ``sample`` documents, at most ``most`` characters of each.

    The bound keeps what reaches the driver small; it says how well the frames compress and
    nothing about what they hold. A document's part starts at a hashed place, so every stretch of
    a long text can be learned from. Where the sample is too small to train on, its bytes
    themselves are the dictionary.
    """
    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.lit("dictionary"), id, text), F.lit(1 << 30)) / (1 << 30)
    start = F.pmod(F.xxhash64(F.lit("place"), id, text), F.greatest(F.lit(1), F.length(text) - most + 1)).cast("int")
    chosen = docs.where(draw < sample / total).select(F.col(id).alias("id"), F.substr(text, start + 1, F.lit(most)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [serialize(ids, width) for ids in byte_encoder().encode_all([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "ids"])

    rows = [bytes(r.ids) for r in in_batches(chosen).mapInArrow(run, "id bigint, ids binary").orderBy("id").limit(2 * sample).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(rows)[:DICTIONARY_BYTES] or b"\0" * 8


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if ":/" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def write(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", width: int = 2, end: int = END, level: int = 1) -> list[dict]:
    """Encode and write every document in ascending order of its id; returns the shards in order.

    Null texts count as empty and are stored as the end id; rows without an id are dropped;
    repeated ids are stored as often as they come, in any order, by several tasks if they are
    very many; other columns are ignored, whatever their names. Tasks write under names of their own attempt,
    and only the shards of attempts that ended well are listed, so a lost executor costs a retry.
    """
    docs = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    data = train_dictionary(docs, "id", "text", width)
    digest = hashlib.sha256(data).digest()
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    name = f"{root}/dictionary-{digest.hex()}"
    with fs.open_output_stream(name) as f:
        f.write(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        shard = f"shard-{task.stageId()}-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = open_fs(folder)
        shared = _dictionary(data)
        shared.precompute_compress(level=level)
        compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        encode_all, index, at, last = byte_encoder().encode_all, [], 40, end.to_bytes(4, "little")
        with fs.open_output_stream(f"{root}/{shard}") as f:
            f.write(MAGIC + bytes([width, 0, 0]) + digest)
            batch = first
            while batch is not None:
                for key, ids in zip(batch.column(0).to_pylist(), encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += last
                    f.write(frame := compress(serialize(ids, width)))
                    index.append((key, at, len(ids) // 4))
                    at += len(frame)
                batch = next((b for b in batches if b.num_rows), None)
            entries = np.array(index, ENTRY)
            f.write(entries.tobytes() + at.to_bytes(8, "little") + len(index).to_bytes(8, "little"))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "first_id": index[0][0], "docs": len(index), "tokens": int(entries["ids"].sum())}])

    ordered = docs.repartitionByRange("id", F.rand(7)).sortWithinPartitions("id")  # an id of very many rows is split
    shards = [r.asDict() for r in in_batches(ordered).mapInArrow(run, "shard string, first_id bigint, docs bigint, tokens bigint").collect()]
    shards.sort(key=lambda s: (s["first_id"], s["shard"]))
    start = 0
    for s in shards:
        s["start"] = start
        start += s["tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dictionary": digest.hex(), "width": width, "shards": shards}).encode())
    return shards


class Shard:
    """One shard, open for reading; ``fetch`` reads a document by its place in the index."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = open_fs(folder)
        self.file = self.fs.open_input_file(f"{root}/{name}")
        head = self.file.read(40)
        if head[:5] != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        self.width, digest = head[5], head[8:]
        with self.fs.open_input_stream(f"{root}/dictionary-{digest.hex()}") as f:
            data = f.read()
        if hashlib.sha256(data).digest() != digest:
            raise ValueError(f"the dictionary of {name} has another hash")
        size = self.file.size()
        self.file.seek(size - 16)
        self.stop, n = np.frombuffer(self.file.read(16), "<i8").tolist()
        self.file.seek(self.stop)
        self.index = np.frombuffer(self.file.read(n * ENTRY.itemsize), ENTRY)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(data))

    def fetch(self, k: int) -> np.ndarray:
        at = int(self.index["at"][k])
        stop = int(self.index["at"][k + 1]) if k + 1 < len(self.index) else self.stop
        self.file.seek(at)
        return np.frombuffer(self.decompressor.decompress(self.file.read(stop - at)), f"<u{self.width}").astype("<u4")

    def find(self, id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.index["id"], id))
        return self.fetch(k) if k < len(self.index) and self.index["id"][k] == id else None


def read(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"])
                ids = shard.index["ids"]
                starts = row["start"] + np.cumsum(ids) - ids
                for a in range(0, len(ids), 10_000):
                    b = min(len(ids), a + 10_000)
                    got = [shard.fetch(k) for k in range(a, b)]
                    lengths = np.array([len(x) for x in got], np.int64)
                    crc = [zlib.crc32(x.tobytes()) for x in got]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.index["id"][a:b].copy(), starts[a:b], lengths, np.array(crc, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], "shard string, start bigint")
    return listed.repartition(min(len(shards), 2000)).mapInArrow(run, schema)


def op8_dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return read(spark, folder, write(documents(spark, sf_dir), folder))
