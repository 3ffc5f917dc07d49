"""Many small models as rows: fits by grouped sufficient statistics, coefficients as a table, scoring as a join.

A model is a value of the column ``model``. Training rows name the model they belong to, so a row may
serve several; folds, views, classes and held-out families are values, not loops. A Newton step is
one aggregation: tasks add up what the rows of each model contribute (a gradient, a matrix of second
moments, the loss), the sums are added by place, and one row a model is solved. Only the number of
steps is counted on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.sources.io import stored

#: Models whose coefficients are sent to all tasks; with more, rows and coefficients meet by a shuffle.
SENT = 20_000
#: Models for which a task adds up before it hands its sums on.
HELD = 2_000


def balanced(rows: DataFrame, label: str = "y", weight: str = "w") -> DataFrame:
    """Weights times n / (2 * rows of the class), class by class in each model; models with one class only are dropped."""
    n = rows.groupBy("model").agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p")).where("_p > 0 and _p < _n")
    n = F.broadcast(n) if n.count() <= SENT else n
    own = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return rows.join(n, "model").withColumn(weight, F.col(weight) * F.col("_n") / (2 * own)).drop("_n", "_p")


def _matrix(column: pa.Array) -> np.ndarray:
    """Numbers as a vector, arrays of one length as a matrix."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).astype(float)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _added(rows: DataFrame, columns: list[str], contribution: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """``model, stats``: the sums, place by place, of what the rows of each model contribute.

    ``columns`` are arrays or numbers; ``contribution`` gets them as numpy arrays for rows of one model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["model", "stats"])
            sums.clear()
            return out

        for batch in batches:
            model = batch.column(0).dictionary_encode()
            codes, names = model.indices.to_numpy(), model.dictionary.to_pylist()
            for code, name in enumerate(names):
                mine = batch.columns[1:] if len(names) == 1 else [c.filter(pa.array(codes == code)) for c in batch.columns[1:]]
                part = contribution([_matrix(c) for c in mine])
                sums[name] = sums[name] + part if name in sums else part
            if len(sums) > HELD:
                yield emit()
        if sums:
            yield emit()

    partial = rows.select("model", *columns).mapInArrow(run, "model string, stats array<double>")
    places = partial.select("model", F.posexplode("stats").alias("pos", "v")).groupBy("model", "pos").agg(F.sum("v").alias("v"))
    return places.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("stats"))


def _scales(stats: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of each feature from (n, sums, sums of squares); a constant feature keeps the scale 1."""
    n = F.element_at(stats, 1)
    d = ((F.size(stats) - 1) / 2).cast("int")
    mean = F.transform(F.slice(stats, F.lit(2), d), lambda s: s / n)
    square = F.slice(stats, d + 2, d)
    variance = F.zip_with(square, mean, lambda s, m: s / n - m * m)
    return mean, F.zip_with(variance, square, lambda v, s: F.when(v > 1e-12 * F.greatest(s / n, F.lit(1e-300)), F.sqrt(v)).otherwise(1.0))


def standardise(x: Column, mean: Column, scale: Column) -> Column:
    centred = F.zip_with(x, mean, lambda v, m: v - m)
    return F.zip_with(centred, scale, lambda v, s: v / s)


def _sent(models: DataFrame, n: int | None = None) -> DataFrame:
    """``models``, sent to all tasks if they are ``n`` (counted where it is not given) and no more than ``SENT``."""
    return F.broadcast(models) if (models.count() if n is None else n) <= SENT else models


def _newton(args: list[np.ndarray]) -> np.ndarray:
    """Loss, gradient and second moments of weighted logistic rows at their model's coefficients."""
    x, y, w, coef = args
    if not len(y):
        return np.zeros(0)
    x = np.hstack([x, np.ones((len(x), 1))])
    z = x @ coef[0]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
    return np.concatenate([[loss], x.T @ (w * (p - y)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])


def fit_logistic(rows: DataFrame, ridge: float = 1 / 0.3, steps: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """``model, mean, scale, coef``: weighted logistic regressions with an L2 term, one for each value of ``model``.

    ``rows`` is ``model string, x array<double>, y, w``. Features are scaled by their plain mean and deviation in the
    model's rows; ``coef`` ends with the intercept, which the L2 term (``ridge`` / 2 times the square) covers too, so every fit has
    one optimum; models may have different numbers of features. Newton steps go on until no coefficient of any model moves by ``tolerance``; a step that
    raises the loss is halved. Rows with a null feature, label or weight are left out.
    """
    rows = rows.where("model is not null and y is not null and w is not null and x is not null and not exists(x, v -> v is null or isnan(v))")
    rows = stored(rows.select("model", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")))
    sums = _added(rows, ["x"], lambda a: np.concatenate([[len(a[0])], a[0].sum(0), (a[0] ** 2).sum(0)]))
    mean, scale = _scales(F.col("stats"))
    scales = stored(sums.select("model", mean.alias("mean"), scale.alias("scale")))
    n = scales.count()
    scaled = stored(rows.join(_sent(scales, n), "model").select("model", standardise(F.col("x"), F.col("mean"), F.col("scale")).alias("x"), "y", "w"))
    zero = F.transform(F.concat("mean", F.array(F.lit(0.0))), lambda _: F.lit(0.0))
    state = stored(scales.select("model", zero.alias("coef"), zero.alias("before"), F.lit(float("inf")).alias("loss"), F.lit(float("inf")).alias("moved")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("model", "coef", "before", "loss", "moved")}
            for r in batch.to_pylist():
                coef, before, stats = np.array(r["coef"]), np.array(r["before"]), np.array(r["stats"])
                d = len(coef)
                loss = stats[0] + ridge / 2 * coef @ coef
                if loss > r["loss"] + 1e-12 * abs(r["loss"]):
                    new, before, loss = (coef + before) / 2, before, r["loss"]
                else:
                    gradient = stats[1 : d + 1] + ridge * coef
                    new, before = coef - np.linalg.solve(stats[d + 1 :].reshape(d, d) + ridge * np.eye(d), gradient), coef
                for c, v in zip(out, (r["model"], new.tolist(), before.tolist(), loss, float(np.abs(new - coef).max()))):
                    out[c].append(v)
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(out["model"], pa.string()), pa.array(out["coef"], lists), pa.array(out["before"], lists), pa.array(out["loss"], pa.float64()), pa.array(out["moved"], pa.float64())], list(out))

    kind = "model string, coef array<double>, before array<double>, loss double, moved double"
    for _ in range(steps):
        at = scaled.join(_sent(state.select("model", "coef"), n), "model")
        stats = _added(at, ["x", "y", "w", "coef"], _newton)
        state = stored(state.join(stats, "model").select("model", "coef", "before", "loss", "stats").mapInArrow(solve, kind))
        if not (state.agg(F.max("moved")).first()[0] or 0) > tolerance:
            break
    return state.select("model", "coef").join(scales, "model").select("model", "mean", "scale", "coef")


def logistic_score(x: Column, mean: Column, scale: Column, coef: Column) -> Column:
    """Probability of the class 1 for features that stand beside their model's row."""
    z = F.aggregate(F.zip_with(F.concat(standardise(x, mean, scale), F.array(F.lit(1.0))), coef, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return 1 / (1 + F.exp(-z))


def score_rows(rows: DataFrame, models: DataFrame, out: str = "score") -> DataFrame:
    """``rows`` (with ``model`` and ``x``) and their score; rows of models that could not be fitted have a null."""
    found = rows.join(_sent(models), "model", "left")
    return found.withColumn(out, logistic_score(F.col("x"), F.col("mean"), F.col("scale"), F.col("coef"))).drop("mean", "scale", "coef")


def _moments(args: list[np.ndarray]) -> np.ndarray:
    x, y, w = args
    x = np.hstack([x, np.ones((len(x), 1)), y[:, None]])
    return ((x * w[:, None]).T @ x).ravel()


def weighted_gram(rows: DataFrame) -> DataFrame:
    """``model, gram``: weighted second moments of (features, 1, label) of each model's rows, as a flat square matrix."""
    return _added(rows, ["x", "y", "w"], _moments).withColumnRenamed("stats", "gram")


def of_other_folds(grams: DataFrame) -> DataFrame:
    """Matrices of folds, turned into those of all other folds: second moments add up, so no row is read again.

    ``model`` is the fold. There are few folds, and a matrix for each.
    """
    folds = grams.select(F.col("model").alias("_f"))
    places = grams.join(F.broadcast(folds), F.col("model") != F.col("_f")).select("_f", F.posexplode("gram").alias("pos", "v"))
    sums = places.groupBy("_f", "pos").agg(F.sum("v").alias("v"))
    return sums.groupBy("_f").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("gram")).select(F.col("_f").alias("model"), "gram")


def solve_masks(grams: DataFrame, masks: DataFrame, ridge: float) -> DataFrame:
    """``model, mask, coef``: least squares with an L2 term for every mask of every model, from the model's one matrix.

    ``masks`` is ``mask string, places array<int>`` (places of the features that stay, from 0). Features are centred and scaled by the
    weighted moments that the matrix holds; ``coef`` applies to features as they were, ends with the intercept and is 0 outside
    the mask. The L2 term is ``ridge`` times the sum of weights; it leaves the intercept out.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for r in batch.to_pylist():
                d = int(round(len(r["gram"]) ** 0.5)) - 2
                g = np.array(r["gram"]).reshape(d + 2, d + 2)
                total = g[d, d]
                mean, label = g[d, :d] / total, g[d, d + 1] / total
                spread = np.diag(g)[:d] / total - mean**2
                scale = np.where(spread > 1e-12 * np.maximum(np.diag(g)[:d] / total, 1e-300), np.sqrt(np.maximum(spread, 0)), 1.0)
                keep = np.array(sorted(p for p in r["places"] if 0 <= p < d), int)
                second = (g[:d, :d] / total - np.outer(mean, mean))[np.ix_(keep, keep)] / np.outer(scale[keep], scale[keep])
                first = (g[:d, d + 1] / total - mean * label)[keep] / scale[keep]
                coef = np.zeros(d + 1)
                coef[keep] = np.linalg.solve(second + ridge * np.eye(len(keep)), first) / scale[keep]
                coef[d] = label - coef[:d] @ mean
                for c, v in zip(out, (r["model"], r["mask"], coef.tolist())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.float64()))], ["model", "mask", "coef"])

    both = grams.withColumn("mask", F.explode(F.array(*(F.lit(m) for m in _names(masks))))).join(F.broadcast(masks), "mask")
    return both.select("model", "gram", "mask", "places").mapInArrow(solve, "model string, mask string, coef array<double>")


def _names(masks: DataFrame) -> list[str]:
    """Masks are a hand-written list, one row each."""
    return [r.mask for r in masks.select("mask").distinct().orderBy("mask").collect()]


def linear_score(x: Column, coef: Column) -> Column:
    return F.aggregate(F.zip_with(F.concat(x, F.array(F.lit(1.0))), coef, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def masks_table(spark, masks: dict[str, Iterable[int]]) -> DataFrame:
    return spark.createDataFrame([(name, sorted(places)) for name, places in masks.items()], "mask string, places array<int>")
