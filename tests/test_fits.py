"""Many small models as rows against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanlight.operators import fits


def plain_logistic(x, y, w, ridge):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    for _ in range(20_000):  # plain gradient steps: nothing in common with the fit but the optimum
        p = 1 / (1 + np.exp(-z @ b))
        step = z.T @ (w * (p - y)) + ridge * b
        b -= step / (0.25 * (w[:, None] * z**2).sum() + ridge)
        if np.abs(step).max() < 1e-11:
            break
    return b


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    out = {}
    for k in range(5):
        x = rng.normal(size=(60 + 20 * k, 3)) * [1, 5, 0.1] + [0, 3, 7]
        x[:, 2] = 7 if k == 1 else x[:, 2]  # a constant feature
        y = (x[:, 0] + rng.normal(size=len(x)) * (0.001 if k == 2 else 1) > 0).astype(int)  # one model is nearly separable
        out[f"m{k}"] = (x, y, rng.uniform(0.2, 2, len(x)))
    return out


def table(spark, data):
    rows = [(m, [float(v) for v in x], int(y), float(w)) for m, (xs, ys, ws) in data.items() for x, y, w in zip(xs, ys, ws)]
    return spark.createDataFrame(rows, "model string, x array<double>, y int, w double").repartition(3)


def test_logistic_fits_are_optimal(spark, data):
    models = {r.model: r for r in fits.fit_logistic(table(spark, data), ridge=2.0).collect()}
    assert set(models) == set(data)
    for m, (x, y, w) in data.items():
        want = plain_logistic(x, y, w, 2.0)
        assert np.allclose(models[m].coef, want, atol=1e-6)
    scored = fits.score_rows(table(spark, data), fits.fit_logistic(table(spark, data), ridge=2.0)).where("model = 'm0'").toPandas()
    x = np.stack(scored.x)
    b, mean, scale = (np.array(v) for v in (models["m0"].coef, models["m0"].mean, models["m0"].scale))
    assert np.allclose(scored.score, 1 / (1 + np.exp(-(((x - mean) / scale) @ b[:-1] + b[-1]))))


def test_sums_in_pieces_and_shuffled_coefficients(spark, data, monkeypatch):
    whole = {r.model: r.coef for r in fits.fit_logistic(table(spark, data)).collect()}
    monkeypatch.setattr(fits, "HELD", 0)
    monkeypatch.setattr(fits, "SENT", 0)
    pieces = {r.model: r.coef for r in fits.fit_logistic(table(spark, data)).collect()}
    assert all(np.allclose(whole[m], pieces[m]) for m in whole)


def test_balanced_weights_nulls_and_empty(spark, data):
    rows = table(spark, data).withColumn("w", F.lit(1.0))
    rows = rows.unionByName(spark.createDataFrame([("one class", [1.0, 1.0, 1.0], 1, 1.0), (None, [1.0, 1.0, 1.0], 1, 1.0)], rows.schema))
    sums = fits.balanced(rows).groupBy("model", "y").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    assert set(sums.model) == set(data)
    both = sums.groupby("model").w.agg(["min", "max"])
    assert np.allclose(both["min"], both["max"])
    odd = table(spark, data).unionByName(spark.createDataFrame([("m0", None, 1, 1.0), ("m0", [1.0, None, 2.0], 0, 1.0), ("m0", [1.0, 1.0, 1.0], None, 1.0), ("m0", [1.0, 1.0, 1.0], 1, None)], "model string, x array<double>, y int, w double"))
    a, b = ({r.model: r.coef for r in fits.fit_logistic(t).collect()} for t in (table(spark, data), odd))
    assert all(np.allclose(a[m], b[m]) for m in a)
    assert fits.fit_logistic(rows.limit(0)).count() == 0


def test_masks_from_one_matrix(spark, data):
    grams = fits.weighted_gram(table(spark, data))
    masks = {"all": [0, 1, 2], "first": [0], "none": [], "last two": [1, 2]}
    found = {(r.model, r["mask"]): r.coef for r in fits.solve_masks(grams, fits.masks_table(spark, masks), 0.01).collect()}
    assert len(found) == len(data) * len(masks)
    for m, (x, y, w) in data.items():
        mean = (w[:, None] * x).sum(0) / w.sum()
        scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
        scale = np.where(scale > 1e-9, scale, 1)
        for name, keep in masks.items():
            z = ((x - mean) / scale)[:, keep]
            target = y - (w * y).sum() / w.sum()
            b = np.linalg.solve((w[:, None] * z).T @ z / w.sum() + 0.01 * np.eye(len(keep)), (w[:, None] * z).T @ target / w.sum()) if keep else np.zeros(0)
            want = z @ b + (w * y).sum() / w.sum()
            assert np.allclose(x @ np.array(found[m, name])[:-1] + found[m, name][-1], want, atol=1e-6)


def test_models_of_different_widths(spark, data):
    x, y, w = data["m0"]
    wide = [("wide", [float(v) for v in r], int(t), float(u)) for r, t, u in zip(x, y, w)]
    thin = [("thin", [float(r[0])], int(t), float(u)) for r, t, u in zip(x, y, w)]
    found = {r.model: r.coef for r in fits.fit_logistic(spark.createDataFrame(wide + thin, "model string, x array<double>, y int, w double").coalesce(1), ridge=2.0).collect()}
    assert np.allclose(found["wide"], plain_logistic(x, y, w, 2.0), atol=1e-6) and np.allclose(found["thin"], plain_logistic(x[:, :1], y, w, 2.0), atol=1e-6)
