"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by exactly these characters: space and code points 9 to 13.
SPACES = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Where the setting is missing, a local run gets a temporary folder; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of keys (16 bytes each) is broadcast; beyond it the join is a shuffle.
BROADCAST_KEYS = 1_000_000


def those_of(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``keys``; few keys are sent to where the rows lie."""
    keys = keys.select(on)
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")


def in_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after its session was told to hand at most ``rows`` rows at once to Python.

    Spark also bounds a batch by bytes; fewer rows keep whole texts, their copies and what is
    computed from them small beside the other tenants of an executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % folds == 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Where a public tokenizer's file lies; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
