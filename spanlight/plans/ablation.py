"""Feature-mask ablations of the process ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import fits
from spanlight.operators import metrics as M
from spanlight.operators import models as L
from spanlight.plans.graph import process_vectors
from spanlight.plans.registry import query
from spanlight.sources.io import stored

FOLDS = 3
#: Groups of features that a mask leaves out or keeps alone.
DESCRIPTORS = ("path_depth", "name_length_log", "exe_length_log", "f_system_binary", "f_user_binary", "has_parent")
SOCKETS = ("log_near_socket", "log_socket_address", "log_socket_port", "log_socket_both", "max_socket_proximity", "log_operation_connect")
TIME_AND_DEGREE = ("time_proximity", "log_closest", "f_degree_score", "f_recency_degree", "log_incident", "log_in", "log_out", "in_fraction")


def masks(features: list[str]) -> dict[str, set[str]]:
    """M4: the ablations and the shortcut configurations, as sets of the features that stay."""
    every = set(features)
    utility = {f for f in features if f.startswith("utility_")}
    semantics = utility | set(DESCRIPTORS)
    out = {
        "full": every,
        "without_process_semantics": every - semantics,
        "without_socket_bridge": every - set(SOCKETS),
        "temporal_degree_only": set(TIME_AND_DEGREE),
        "process_semantics_only": semantics,
        "without_utility_indicators": every - utility,
        "without_path_length_parent": every - set(DESCRIPTORS),
        "without_all_process_semantics": every - utility - set(DESCRIPTORS),
    }
    unknown = set().union(*out.values()) - every
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return out


def ablation_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Vectors ``x`` of all processes with their label ``y`` and fold, and the names of the features."""
    found, vectors = process_vectors(spark, sf_dir)
    features = [c for c in vectors.columns if c not in ("case_id", "id")]
    x = F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in features)).alias("x")
    labels = found.where("kind = 'process'").select("case_id", "id", F.col("label").alias("y"))
    fold = (F.conv(F.substring(F.md5("case_id"), 1, 8), 16, 10).cast("bigint") % FOLDS).cast("string")
    return stored(vectors.select("case_id", "id", x).join(labels, ["case_id", "id"]).withColumn("fold", fold)), features


def ablated_scores(rows: DataFrame, features: list[str], ridge: float = 0.01) -> DataFrame:
    """``case_id, id, y, fold, mask, score``: every row scored under every mask by the other folds' least-squares ranker.

    The rows are read once for one matrix of second moments a fold; all masks are solved from these.
    """
    weighted = L.case_weights(rows, "case_id", "y").select(F.col("fold").alias("model"), "x", F.col("y").cast("double").alias("y"), F.col("weight").alias("w"))
    grams = fits.of_other_folds(stored(fits.weighted_gram(weighted)))
    places = {name: [i for i, f in enumerate(features) if f in kept] for name, kept in masks(features).items()}
    coefs = fits.solve_masks(grams, fits.masks_table(rows.sparkSession, places), ridge).withColumnRenamed("model", "fold")
    return rows.join(F.broadcast(coefs), "fold").select("case_id", "id", "y", "fold", "mask", F.round(fits.linear_score(F.col("x"), F.col("coef")), 9).alias("score"))


@query("m04_feature_ablation")
def m04_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best true ranks under each mask, over the cases that have a true process."""
    rows, features = ablation_rows(spark, sf_dir)
    scored = ablated_scores(rows, features).withColumn("case", F.concat_ws("|", "mask", "case_id"))
    ranks = M.best_ranks(scored, "case", (1, 3, 10)).where("best_rank is not null").withColumn("mask", F.substring_index("case", "|", 1))
    mean = lambda c: F.round(F.avg(c), 9).alias(c)
    return ranks.groupBy("mask").agg(F.count("*").alias("cases_n"), mean("reciprocal"), mean("hit_1"), mean("hit_3"), mean("hit_10"), mean("normalised"))
