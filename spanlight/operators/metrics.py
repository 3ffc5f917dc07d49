"""Ranking metrics, detection thresholds and accept-or-abstain evaluation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.operators.prefix import numbered, running


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def expand(df: DataFrame, name: str, values: Iterable) -> DataFrame:
    """``df`` once for each of a few values."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


# Ranking


def best_ranks(scored: DataFrame, case: str = "case", ks: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """Rank by score and id; best true rank, reciprocal rank (0 without truth), hits and normalised rank (null without)."""
    w = Window.partitionBy(case).orderBy(F.desc("score"), "id")
    r = scored.withColumn("_r", F.row_number().over(w))
    best = F.min(F.when(F.col("y") == 1, F.col("_r")))
    out = r.groupBy(case).agg(F.count("*").alias("candidates"), best.alias("best_rank"), F.max(F.when(F.col("_r") == 1, F.col("id"))).alias("top_id"))
    hits = {f"hit_{k}": F.coalesce((F.col("best_rank") <= k).cast("int"), F.lit(0)) for k in ks}
    return out.withColumns({"reciprocal": F.coalesce(1 / F.col("best_rank"), F.lit(0.0)), "normalised": F.col("best_rank") / F.col("candidates")} | hits)


def tie_bounds(scored: DataFrame, case: str = "case") -> DataFrame:
    """R2: optimistic, pessimistic and middle rank of the best true score, and how many share it."""
    top = F.max(F.when(F.col("y") == 1, F.col("score"))).over(Window.partitionBy(case))
    r = scored.withColumn("_t", top).where("_t is not null")
    better, tied, true = F.col("score") > F.col("_t"), F.col("score") == F.col("_t"), F.col("y") == 1
    out = r.groupBy(case).agg(F.count_if(better).alias("better"), F.count_if(tied).alias("tied"), F.count_if(tied & true).alias("tied_true"))
    return out.select(
        case, (F.col("better") + 1).alias("optimistic"), (F.col("better") + F.col("tied") - F.col("tied_true") + 1).alias("pessimistic"),
        (F.col("better") + (F.col("tied") + 1) / 2).alias("mid_rank"), "tied", "tied_true",
    )


def miss_probability(n: Column, t: Column, k: Column) -> Column:
    """Chance that ``k`` draws without replacement out of ``n`` hit none of ``t``."""
    steps = F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0.0), (n - t - i) / F.greatest(n - i, F.lit(1))))


def hit_probability(n: Column, t: Column, k: Column) -> Column:
    """Chance of at least one true candidate among ``k`` random ones."""
    return F.when((n <= 0) | (t <= 0), F.lit(0.0)).otherwise(1 - miss_probability(n, t, F.least(k, n)))


def expected_reciprocal(n: Column, t: Column, before: Column) -> Column:
    """Expected 1 / rank of the first of ``t`` true among ``n`` shuffled candidates that follow ``before`` others."""
    start = F.struct(F.lit(1.0).alias("miss"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        hit = acc["miss"] * t / (n - i)
        return F.struct((acc["miss"] - hit).alias("miss"), (acc["sum"] + hit / (before + i + 1)).alias("sum"))

    steps = F.when((t > 0) & (n >= t), F.sequence(F.lit(0), (n - t).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda acc: acc["sum"])


def ndcg(scored: DataFrame, k: int, case: str = "case") -> DataFrame:
    """NDCG at ``k``, hit at ``k`` and reciprocal rank of each case with binary truth."""
    w = Window.partitionBy(case).orderBy(F.desc("score"), "id")
    r = scored.withColumn("_r", F.row_number().over(w))
    gain = F.sum(F.when((F.col("_r") <= k) & (F.col("y") == 1), 1 / F.log2(F.col("_r") + 1.0)).otherwise(0.0))
    out = r.groupBy(case).agg(gain.alias("dcg"), F.sum("y").alias("t"), F.min(F.when(F.col("y") == 1, F.col("_r"))).alias("best"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("t"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return out.select(
        case, F.when(F.col("t") > 0, F.col("dcg") / F.when(F.col("t") > 0, ideal)).otherwise(0.0).alias("ndcg"), F.coalesce((F.col("best") <= k).cast("int"), F.lit(0)).alias("hit"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal")
    )


def localisation(ranked: DataFrame, confirmations: DataFrame, ks: Iterable[int] = (1, 3, 5)) -> DataFrame:
    """For each k the hit rate by score and by frequency and their difference, mean effort, and how often counterfactuals confirm.

    ``ranked`` is ``case, id, score, frequency, y``; effort is the first true rank over the candidates, 1 where none is true.
    ``confirmations`` is ``case, eligible, confirmed, preserved`` (0 or 1; ``preserved`` is null where it was not measured).
    A rate over no cases is 0.
    """
    by = lambda c: F.row_number().over(Window.partitionBy("case").orderBy(F.desc(c), "id"))
    true = F.col("y") == 1
    per = ranked.withColumns({"_r": by("score"), "_b": by("frequency")}).groupBy("case").agg(F.count("*").alias("n"), F.min(F.when(true, F.col("_r"))).alias("rank"), F.min(F.when(true, F.col("_b"))).alias("base"))
    per = per.join(confirmations, "case", "left").na.fill(0, ["eligible", "confirmed"])
    hit = lambda c: F.avg(F.coalesce((F.col(c) <= F.col("k")).cast("double"), F.lit(0.0)))
    rate = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    eligible, confirmed = F.sum("eligible"), F.sum("confirmed")
    measured = (F.col("confirmed") == 1) & F.col("preserved").isNotNull()
    return expand(per, "k", ks).groupBy("k").agg(
        F.count("*").alias("cases_n"), hit("rank").alias("hit"), hit("base").alias("baseline_hit"), (hit("rank") - hit("base")).alias("difference"), F.avg(F.coalesce("rank", "n") / F.col("n")).alias("effort"),
        eligible.alias("eligible_n"), confirmed.alias("confirmed_n"), rate(confirmed, F.count("*")).alias("confirmed_all"), rate(confirmed, eligible).alias("confirmed_eligible"),
        F.count_if(measured).alias("measured_n"), rate(F.sum(F.when(measured, F.col("preserved"))), F.count_if(measured)).alias("preserved"),
    )


# Thresholds


def score_steps(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts at each distinct score and running counts from the highest down.

    Rows collapse to distinct scores before anything is ordered, so ties stay whole; scores are
    summed up by ranges, so a key may have any number of them.
    """
    counts = scored.groupBy(*keys, "score").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    return running(counts, keys, [F.desc("score")], {"tp_cum": F.col("tp"), "fp_cum": F.col("fp")})


def select_threshold(scored: DataFrame, keys: list[str], budget: float, hours: float) -> DataFrame:
    """The threshold with the most true positives whose false ones stay within ``budget * hours``.

    Ties: fewer false positives, then the higher threshold. Without any, infinity: no alerts.
    """
    allowed = int(budget * hours + 1e-9)
    fit = score_steps(scored, keys).where(F.col("fp_cum") <= allowed)
    best = fit.groupBy(*keys).agg(F.max(F.struct(F.col("tp_cum").alias("tp"), (-F.col("fp_cum")).alias("less"), "score")).alias("m"))
    every = scored.select(*keys).distinct()
    out = every.join(best, keys, "left")
    return out.select(*keys, F.coalesce("m.score", F.lit(float("inf"))).alias("threshold"), F.coalesce("m.tp", F.lit(0)).alias("true_alerts"), F.coalesce(-F.col("m.less"), F.lit(0)).alias("false_alerts"))


def curve_areas(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision by steps and ROC area with middle ranks; null where one class is missing."""
    s = score_steps(scored, keys)
    total = s.groupBy(*keys).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N")) if keys else s.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    j = s.join(total, keys) if keys else s.crossJoin(F.broadcast(total))
    ap = F.sum(F.col("tp") * F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum")))
    auc = F.sum(F.col("fp") * (F.col("tp_cum") - F.col("tp") / 2.0))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    out = j.groupBy(*keys, "P", "N").agg(ap.alias("ap"), auc.alias("auc"))
    return out.select(*keys, F.when(both, F.col("ap") / F.col("P")).alias("ap"), F.when(both, F.col("auc") / F.col("P") / F.col("N")).alias("auc"))


def window_metrics(scored: DataFrame, keys: list[str], threshold: Column, hours: float) -> DataFrame:
    """D3: precision, recall, alerts and false alerts an hour at a threshold."""
    alert = F.col("score") >= threshold
    tp, fp, pos = F.count_if(alert & (F.col("y") == 1)), F.count_if(alert & (F.col("y") == 0)), F.sum("y")
    return scored.groupBy(*keys).agg((tp + fp).alias("alerts"), ratio(tp, tp + fp).alias("precision"), ratio(tp, pos).alias("recall"), (fp / F.lit(float(hours))).alias("false_per_hour"))


# Accept or abstain


def _score_places(scored: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows at each distinct score (``_n``), at it or above (``_upto``) and in all (``_all``)."""
    per = running(scored.groupBy(*keys, score).agg(F.count("*").alias("_n")), keys, [F.desc(score)], {"_upto": F.col("_n")})
    if not keys:
        return per.crossJoin(F.broadcast(per.agg(F.sum("_n").alias("_all"))))
    sizes = per.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.sum("_n").alias("_all"))
    return per.join(sizes, _same(keys)).drop(*(f"_k_{k}" for k in keys))


def _same(keys: list[str]) -> Column:
    """Keys that are equal or both null, on a side with and one without the prefix ``_k_``."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def fixed_coverage(scored: DataFrame, keys: list[str], coverage: float, score: str = "score", id: str = "case_id") -> DataFrame:
    """A1: the top ``max(1, round(coverage * n))`` of each group, half rounded to even, ties by id.

    Counts of distinct scores give the score at which a group's number is reached; only the rows
    that tie at it are numbered by id, by ranges.
    """
    wanted, before = F.greatest(F.lit(1), F.bround(F.col("_all") * coverage, 0)), F.col("_upto") - F.col("_n")
    cut = _score_places(scored, keys, score).where((before < wanted) & (wanted <= F.col("_upto"))).select(*keys, F.col(score).alias("_cut"), (wanted - before).alias("_left"))
    placed = scored.join(cut, keys)
    above = placed.where((F.col(score) > F.col("_cut")) | F.col("_cut").isNull() & F.col(score).isNotNull())
    tied = numbered(placed.where(F.col(score).eqNullSafe(F.col("_cut"))), keys, [F.asc(id)], "_r")
    return above.select(scored.columns).unionByName(tied.where(F.col("_r") <= F.col("_left")).select(scored.columns))


def kth_thresholds(scored: DataFrame, keys: list[str], share: float) -> DataFrame:
    """A2: score of the rounded and of the ceiling share, and the threshold that accepts exactly the rounded number.

    Where ties prevent an exact number, ``exact`` is null; a number of 0 gives infinity.
    """
    p = _score_places(scored, keys, "score")
    at = lambda k: F.max(F.when(F.col("_upto") >= k, F.col("score")))
    rounded, up = F.bround(F.col("_all") * share, 0), F.ceil(F.col("_all") * share)
    out = p.groupBy(*keys).agg(at(F.greatest(F.lit(1), rounded)).alias("rounded"), at(F.greatest(F.lit(1), up)).alias("retained"), at(rounded + 1).alias("_next"), F.max(rounded).alias("_k"))
    exact = F.when(F.col("_k") == 0, F.lit(float("inf"))).when(F.col("_next").isNull() | (F.col("_next") < F.col("rounded")), F.col("rounded"))
    return out.select(*keys, "rounded", "retained", exact.alias("exact"))


def kth_score(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """A3: the ``k``-th highest score of each group as ``threshold`` (null if it has fewer rows) and its ``rows_n``."""
    p = _score_places(scored, keys, "score")
    return p.groupBy(*keys).agg(F.max(F.when(F.col("_upto") >= k, F.col("score"))).alias("threshold"), F.sum("_n").alias("rows_n"))


def outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A4: acceptance, errors over all rows, risk over accepted ones and rejection."""
    accepted, right = F.col("accepted") == 1, F.col("correct") == 1
    n, a, ok = F.count("*"), F.count_if(accepted), F.count_if(accepted & right)
    out = rows.groupBy(*keys).agg(n.alias("events_n"), a.alias("accepted_n"), ok.alias("correct_n"))
    a, ok, n = F.col("accepted_n"), F.col("correct_n"), F.col("events_n")
    return out.withColumns({"wrong_n": a - ok, "coverage": ratio(a, n), "wrong_rate": ratio(a - ok, n), "risk": ratio(a - ok, a), "rejection": ratio(n - a, n)})


def risk_curve(rows: DataFrame, keys: list[str], score: str = "score", id: str = "case_id") -> DataFrame:
    """Rank by score with running errors, the base of A6 and A7; a model's rows are ordered by ranges."""
    wrong = (1 - F.col("correct")).cast("bigint")
    return running(rows, keys, [F.desc(score), F.asc(id)], {"rank": F.lit(1).cast("bigint"), "errors": wrong})


def mid_percentile(values: DataFrame, reference: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Share of the reference below each value plus half of the share equal to it.

    Both sides meet as counts of distinct scores, which are summed up by ranges.
    """
    counts = values.select(*keys, score, F.lit(0).alias("_n")).distinct().unionByName(reference.groupBy(*keys, score).agg(F.count("*").cast("int").alias("_n")))
    per = running(counts.groupBy(*keys, score).agg(F.sum("_n").alias("_n")), keys, [F.asc(score)], {"_upto": F.col("_n")})
    sizes = reference.groupBy(*keys).agg(F.count("*").alias("_all"))
    table = per.join(sizes, keys, "left") if keys else per.crossJoin(F.broadcast(sizes))
    table = table.withColumn("percentile", ratio(F.col("_upto") - F.col("_n") / 2, F.col("_all"))).drop("_n", "_upto", "_all")
    return values.join(table, [*keys, score])


def calibration_error(rows: DataFrame, keys: list[str], bins: int = 5) -> DataFrame:
    """A10: expected calibration error over equal bins of confidence, the last one closed."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = rows.groupBy(*keys, b.alias("_b")).agg(F.count("*").alias("n"), F.avg("score").alias("c"), F.avg("correct").alias("a"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.count("*").alias("bins_used"))


def class_scores(rows: DataFrame, keys: list[str], truth: str = "tactic", pred: str = "prediction") -> DataFrame:
    """Accuracy and macro F1 over the classes that occur as truth or prediction."""
    pairs = rows.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col(truth) == F.col(pred)).cast("int").alias("hit"))
    per = pairs.groupBy(*keys, "x.c").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum(F.col("hit") * F.col("x.t")).alias("hit"))
    return per.groupBy(*keys).agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("hit") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def confusion(rows: DataFrame, truth: str = "tactic", pred: str = "prediction") -> DataFrame:
    """All cells of the confusion matrix, zeros included."""
    t, p = rows.select(F.col(truth).alias("truth")).distinct(), rows.select(F.col(pred).alias("predicted")).distinct()
    n = rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(p)).join(n, ["truth", "predicted"], "left").na.fill(0, ["n"])
