"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlight.llm.common import documents, materialize
from spanlight.llm.jaccard import deduplicate
from spanlight.llm.langid import keep_identified
from spanlight.llm.mixing import sample_mixture
from spanlight.llm.packing import pack
from spanlight.llm.pii import sanitize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and an identified language stay, all columns as they are.

    Null and empty texts go; whole texts are read, however long; repeated rows are decided alike; an empty table stays empty.
    """
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id, all columns as they are.

    Null and empty texts are one group; of equal rows one stays; rows without an id stay; an empty table stays empty.
    """
    return deduplicate(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that disclose them are generalised in the text; no row goes.

    Null and empty texts stay as they are; repeated rows change alike; an empty table stays empty.
    """
    return sanitize(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled with raked weights, those of large weights twice at most; all columns stay.

    Null sources, languages and texts are treated as ``spanlight.llm.mixing.calibrate`` states; an empty table stays empty.
    """
    return sample_mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed; one row for each piece.

    Null and empty texts are one piece of the end id; repeated rows are packed as often as they come; an empty table gives an empty result.
    """
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Networks, fingerprints and tokenizers have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
