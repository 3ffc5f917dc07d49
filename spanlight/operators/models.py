"""Detectors, rankers and classifiers with Spark ML, and the features and scores around them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.functions.scalars import draw
from spanlight.operators.prefix import numbered
from spanlight.sources.io import scratch_dir, stored


def balanced_weights(rows: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """M2: weight n / (number of classes * rows of the class)."""
    per = rows.groupBy(*keys, label).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    table = per.withColumn("weight", F.sum("_c").over(w) / (F.count("*").over(w) * F.col("_c"))).drop("_c")
    return rows.join(F.broadcast(table), [*keys, label])


def oversample(rows: DataFrame, label: str, id: str, seed: str) -> DataFrame:
    """M2: rows of the smaller class once more as often as a hash of (seed, copy) picks their place, until classes are equal."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) != 2 or len(set(counts.values())) == 1:
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    small = min(counts, key=lambda k: (counts[k], k))
    n, extra = counts[small], max(counts.values()) - counts[small]
    draws = rows.sparkSession.range(1, extra + 1).select(F.col("id").alias("copy"), F.floor(draw(F.lit(seed), F.col("id").cast("string")) * n).alias("_place"))
    placed = numbered(rows.where(F.col(label) == small), [label], [F.asc(id)], "_place").withColumn("_place", F.col("_place") - 1)
    return rows.withColumn("copy", F.lit(0).cast("bigint")).unionByName(draws.join(placed, "_place").drop("_place"))


def case_weights(rows: DataFrame, case: str, label: str) -> DataFrame:
    """M3: weights with which true and other rows of a case each add up to one half; cases with one kind only are dropped."""
    w = Window.partitionBy(case)
    both = rows.withColumns({"_p": F.sum(label).over(w), "_n": F.sum(1 - F.col(label)).over(w)}).where("_p > 0 and _n > 0")
    return both.withColumn("weight", F.when(F.col(label) == 1, 0.5 / F.col("_p")).otherwise(0.5 / F.col("_n"))).drop("_p", "_n")


def _classifier(name: str, features: int, classes: int):
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "predicted"}
    if name == "logistic":
        return LogisticRegression(maxIter=20, regParam=0.01, weightCol="weight", **common)
    if name == "trees":
        return GBTClassifier(maxIter=4, maxDepth=3, seed=7, weightCol="weight", **common)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[features, 8, max(2, classes)], maxIter=20, seed=7, **common)
    raise ValueError(name)


def without_summary(fitted, spark: SparkSession):
    """``fitted`` as it is read back from the shared folder, without the summary of its training.

    The summary of a binary model holds the session, and a session that has observed any write can't go to tasks.
    """
    if not getattr(fitted, "hasSummary", False):
        return fitted
    path = scratch_dir(spark)
    fitted.write().save(path)
    return type(fitted).load(path)


def out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str, models: Iterable[str] = ("logistic",)) -> DataFrame:
    """Scores of each fold's rows from models fitted on the other folds.

    ``rows`` has a ``weight``. Features are assembled and scaled once a fold; scores of all
    models and folds are one union. A fold without two classes to learn from is left out.
    """
    assembled = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep").transform(rows.withColumn("label", F.col(label).cast("double")))
    assembled = stored(assembled)
    parts: list[DataFrame] = []
    stats = {(r.f, r.c) for r in assembled.groupBy(F.col(fold).alias("f"), F.col("label").alias("c")).count().collect()}
    folds = sorted({f for f, _ in stats})
    for f in folds:
        seen = {c for g, c in stats if g != f}
        if len(seen) < 2:
            continue
        train, test = assembled.where(F.col(fold) != f), assembled.where(F.col(fold) == f)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        for name in models:
            fitted = without_summary(_classifier(name, len(features), int(max(seen)) + 1).fit(scaler.transform(train)), rows.sparkSession)
            scored = fitted.transform(scaler.transform(test)).withColumn("probabilities", vector_to_array("probability"))
            parts.append(scored.drop("raw", "features", "rawPrediction", "probability").withColumn("model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tfidf(docs: DataFrame, id: str, text: str, terms: int = 500) -> DataFrame:
    """M6: ``id, term, value``: 1- and 2-grams of words of two or more letters or digits, the commonest ``terms``, 1 + ln(tf), smoothed idf, unit length.

    A pair occurs at most as often as either of its words. So once the words are counted, only pairs of two words as common
    as the ``terms``-th word can be among the commonest, and only these are counted; frequencies within documents are
    counted for the chosen terms alone. What is shuffled is counts of words, of pairs of common words, and at most ``terms`` rows a document.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    listed = stored(docs.select(F.col(id).alias("id"), words.alias("w")))
    pairs = F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p")
    single = listed.select("id", F.explode("w").alias("a"))
    double = listed.where(F.size("w") > 1).select("id", pairs).select("id", "p.a", "p.b")
    counts = stored(single.groupBy("a").agg(F.count("*").alias("total")))
    least = counts.orderBy(F.desc("total")).limit(terms).agg(F.min("total")).first()[0] if counts.count() > terms else 0
    common = counts.where(F.col("total") >= least).select("a")
    few = F.broadcast if common.count() <= 100_000 else lambda df: df  # many words may tie
    paired = double.join(few(common), "a", "left_semi").join(few(common.withColumnRenamed("a", "b")), "b", "left_semi")
    paired = paired.groupBy("a", "b").agg(F.count("*").alias("total"))
    every = counts.select("a", F.lit(None).cast("string").alias("b"), "total").unionByName(paired).withColumn("term", F.concat_ws(" ", "a", "b"))
    vocabulary = stored(every.orderBy(F.desc("total"), "term").limit(terms).select("a", "b", "term"))
    said = single.join(F.broadcast(vocabulary.where("b is null").select("a", "term")), "a").select("id", "term")
    said = said.unionByName(double.join(F.broadcast(vocabulary.where("b is not null")), ["a", "b"]).select("id", "term"))
    tf = stored(said.groupBy("id", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    value = (1 + F.log(F.col("tf"))) * (F.log((1 + F.lit(listed.count())) / (1 + F.col("df"))) + 1)
    kept = tf.join(F.broadcast(df), "term").select("id", "term", value.alias("value"))  # one row a chosen term
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id")))
    return kept.select(F.col("id").alias(id), "term", (F.col("value") / norm).alias("value"))


def _clipped(p: Column) -> Column:
    return F.transform(p, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12)))


def _total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def entropy(p: Column) -> Column:
    return -_total(F.transform(_clipped(p), lambda x: x * F.log(x)))


def margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.element_at(s, 1) - F.coalesce(F.try_element_at(s, F.lit(2)), F.lit(0.0))


def js_divergence(p: Column, q: Column) -> Column:
    def unit(x: Column) -> Column:
        c = _clipped(x)
        return F.transform(c, lambda v: v / _total(c))

    a, b = unit(p), unit(q)
    kl = lambda x, y: F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(0.0)
    return 0.5 * _total(F.zip_with(a, b, kl)) + 0.5 * _total(F.zip_with(b, a, kl))


def affinity(p: Column, q: Column) -> Column:
    """Bhattacharyya affinity."""
    return _total(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)))


def l1_distance(p: Column, q: Column) -> Column:
    return _total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def pair_features(p: Column, q: Column, classes: int) -> dict[str, Column]:
    """M7, M8: posterior terms of two views and the products of all their classes."""
    out = {"entropy_a": entropy(p), "entropy_b": entropy(q), "margin_a": margin(p), "margin_b": margin(q), "js": js_divergence(p, q), "affinity": affinity(p, q), "l1": l1_distance(p, q)}
    at = lambda x, i: F.element_at(x, i + 1)
    return out | {f"x_{i}_{j}": at(p, i) * at(q, j) for i in range(classes) for j in range(classes)}


def corrupt(rows: DataFrame, families: Iterable[str], donors: DataFrame | None = None) -> DataFrame:
    """M9: ranked-process rows (``case_id, id, rank, score, sockets, delta``, and any others) once for each corruption family.

    delete_process drops all rows; delete_socket zeroes socket counts; shift_time moves by 600 s;
    half_delete keeps rows of even hash, and the first if none is left, with counts halved half to even;
    replace_context shows the rows of the case's donor (``donors``: ``case_id, donor_id``), none without one.
    """
    out = rows.withColumn("family", F.explode(F.array(*(F.lit(f) for f in families if f != "replace_context"))))
    even = F.conv(F.substring(F.sha2(F.concat_ws("|", "case_id", "id"), 256), 16, 1), 16, 10).cast("int") % 2 == 0
    some = F.max(even.cast("int")).over(Window.partitionBy("case_id", "family")) == 1
    half = F.col("family") == "half_delete"
    out = out.withColumns({"_even": even, "_some": some})
    kept = out.where((F.col("family") != "delete_process") & (~half | F.col("_even") | ~F.col("_some") & (F.col("rank") == 1))).drop("_even", "_some")
    changed = {
        "sockets": F.when(F.col("family") == "delete_socket", 0).when(half, F.bround(F.col("sockets") / 2, 0)).otherwise(F.col("sockets")).cast("bigint"),
        "delta": F.when(F.col("family") == "shift_time", F.col("delta") + 600).otherwise(F.col("delta")),
    }
    kept = kept.withColumns(changed)
    if "replace_context" in families and donors is not None:
        asked = donors.where("donor_id is not null").select(F.col("case_id").alias("_for"), F.col("donor_id").alias("case_id"))
        moved = rows.join(asked, "case_id").withColumns({"case_id": F.col("_for"), "family": F.lit("replace_context"), "sockets": F.col("sockets").cast("bigint")}).drop("_for")
        kept = kept.unionByName(moved)
    return kept


def majority_baseline(rows: DataFrame, fold: str, label: str) -> DataFrame:
    """Accuracy on each fold of the commonest class of the other folds, the smaller of equals."""
    per = rows.groupBy(F.col(fold).alias("fold"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    folds = per.select(F.col("fold").alias("test")).distinct()
    best = folds.join(per, F.col("test") != F.col("fold")).groupBy("test", "label").agg(F.sum("n").alias("n")).groupBy("test").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m"))
    chosen = best.select(F.col("test").alias("fold"), (-F.col("m.l")).alias("predicted"))
    scored = per.join(F.broadcast(chosen), "fold")
    hit = F.col("label") == F.col("predicted")
    return scored.groupBy("fold", "predicted").agg(F.sum("n").alias("n"), (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
