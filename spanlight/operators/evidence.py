"""What a case shows under each corruption, the posteriors of its views, and the models that accept or abstain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.operators.models import corrupt, entropy, js_divergence, margin

FAMILIES = ("delete_process", "delete_socket", "shift_time", "half_delete", "replace_context")
SUMMARY = (
    "log_process_candidates", "log_total_entities", "log_relations", "process_fraction", "file_fraction", "socket_fraction", "top_rank_score", "rank_score_margin",
    "rank_score_entropy", "top3_score_mass", "top3_time_proximity", "top3_socket_neighbor_count", "top3_stability_30s",
)
AGREEMENT = (
    "combined_confidence", "combined_margin", "combined_entropy", "network_confidence", "network_margin", "provenance_confidence", "provenance_margin",
    "js_network_provenance", "js_combined_network", "js_combined_provenance", "network_provenance_agreement", "all_view_agreement",
)
#: Features of the controller, and the parts of them that the other two models see.
CONTROLLER = AGREEMENT + SUMMARY
POSTERIOR = ("combined_confidence", "combined_margin", "combined_entropy")
INTEGRITY = (
    "js_network_provenance", "js_combined_network", "js_combined_provenance", "network_provenance_agreement", "all_view_agreement",
    "log_process_candidates", "log_total_entities", "log_relations", "socket_fraction", "top3_stability_30s",
)
VIEWS = ("network", "provenance", "combined")


def process_score(incident: Column, proximity: Column, sockets: Column) -> Column:
    return F.round(F.log1p(incident) + proximity + F.log1p(sockets), 6)


def hash_order(salt: str, case: str, id: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), F.col(case), F.col(id)), 256)


def variants(processes: DataFrame, donors: DataFrame) -> DataFrame:
    """``case_id, variant, id, incident, sockets, closest, proximity``: each case's processes clean, under every corruption family and after two deletions.

    ``processes`` is ``case_id, id, incident, sockets, closest, proximity``, ``donors`` ``case_id, donor_id``. The deletions
    drop the k = min(3, n / 2) best processes, or k of the others in hash order; they are made for cases of four processes or more.
    """
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "id")
    ranked = processes.withColumn("score", process_score(F.col("incident"), F.col("proximity"), F.col("sockets"))).withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumnRenamed("closest", "delta")
    families = corrupt(ranked, FAMILIES, donors).withColumn("proximity", F.when(F.col("family") == "shift_time", 0.0).otherwise(F.col("proximity")))
    columns = ["case_id", F.col("family").alias("variant"), "id", "incident", "sockets", F.col("delta").alias("closest"), "proximity"]
    k = F.least(F.lit(3), F.floor(F.col("_n") / 2))
    counted = ranked.withColumn("_n", F.count("*").over(Window.partitionBy("case_id"))).where("_n >= 4").withColumn("_top", F.col("rank") <= k)
    placed = counted.withColumn("_place", F.row_number().over(Window.partitionBy("case_id", "_top").orderBy(hash_order("random-delete", "case_id", "id"))))
    gone = {"delete_top": ~F.col("_top"), "delete_random": F.col("_top") | (F.col("_place") > k)}
    out = families.select(columns).unionByName(ranked.withColumn("family", F.lit("clean")).select(columns))
    for name, kept in gone.items():
        out = out.unionByName(placed.where(kept).withColumn("family", F.lit(name)).select(columns))
    return out


def summaries(rows: DataFrame, radius: float) -> DataFrame:
    """Ranked-score features of each case and variant, from one aggregation over its ranked processes."""
    score = process_score(F.col("incident"), F.col("proximity"), F.col("sockets"))
    moved = process_score(F.col("incident"), F.greatest(F.lit(0.0), 1 - (F.col("closest") + 30) / radius), F.col("sockets"))
    group = Window.partitionBy("case_id", "variant")
    r = rows.withColumns({"score": score, "moved": moved})
    r = r.withColumns({"r": F.row_number().over(group.orderBy(F.desc("score"), "id")), "m": F.row_number().over(group.orderBy(F.desc("moved"), "id")), "p": F.col("score") / F.sum("score").over(group)})
    top, p = F.col("r") <= 3, F.greatest(F.col("p"), F.lit(1e-12))
    first, second = (F.max(F.when(F.col("r") == i, F.col("score"))) for i in (1, 2))
    both = F.count_if(top & (F.col("m") <= 3))
    out = r.groupBy("case_id", "variant").agg(
        F.count("*").alias("n"), first.alias("top_rank_score"), (first - F.coalesce(second, F.lit(0.0))).alias("rank_score_margin"), (-F.sum(p * F.log(p)) / F.greatest(F.log(F.count("*")), F.lit(1.0))).alias("rank_score_entropy"),
        F.sum(F.when(top, F.col("p"))).alias("top3_score_mass"), F.avg(F.when(top, F.col("proximity"))).alias("top3_time_proximity"), F.avg(F.when(top, F.log1p("sockets"))).alias("top3_socket_neighbor_count"),
        both.alias("both"),
    )
    return out.withColumn("top3_stability_30s", F.col("both") / (2 * F.least(F.lit(3), F.col("n")) - F.col("both"))).drop("both")


def representations(cases: DataFrame, summary: DataFrame, counts: DataFrame, donors: DataFrame, all_variants: Iterable[str]) -> DataFrame:
    """``cases`` once for each variant, with the features named in ``SUMMARY`` (0 where nothing is left).

    ``counts`` is ``case_id, total, processes, files, sockets, relations``. A replaced context has its donor's counts; half
    deletions halve totals half to even; a case without a donor has no replaced context.
    """
    variant = F.col("variant")
    every = cases.withColumn("variant", F.explode(F.array(*map(F.lit, all_variants)))).join(donors, "case_id", "left")
    replaced = variant == "replace_context"
    every = every.where(~replaced | F.col("donor_id").isNotNull()).withColumn("_source", F.when(replaced, F.col("donor_id")).otherwise(F.col("case_id"))).drop("donor_id")
    rows = every.join(counts.withColumnRenamed("case_id", "_source"), "_source", "left").join(summary, ["case_id", "variant"], "left")
    rows = rows.na.fill(0, ["n", "total", "processes", "files", "sockets", "relations", *SUMMARY[6:]]).where(~variant.isin("delete_top", "delete_random") | (F.col("n") > 0))
    half, less = variant == "half_delete", variant.isin("half_delete", "delete_top", "delete_random")
    total = F.when(half, F.greatest(F.col("n"), F.bround(F.col("total") * 0.5, 0))).otherwise(F.col("total"))
    counted = {
        "log_process_candidates": F.log1p("n"), "log_total_entities": F.log1p("_total"), "log_relations": F.log1p(F.when(half, F.bround(F.col("relations") * 0.5, 0)).otherwise(F.col("relations"))),
        "process_fraction": F.when(variant == "delete_process", 0).when(less, F.col("n")).otherwise(F.col("processes")) / F.greatest("_total", F.lit(1.0)),
        "file_fraction": F.col("files") / F.greatest("_total", F.lit(1.0)), "socket_fraction": F.when(variant == "delete_socket", 0).otherwise(F.col("sockets")) / F.greatest("_total", F.lit(1.0)),
    }
    rows = rows.withColumn("_total", total.cast("double")).withColumns({k: c.cast("double") for k, c in counted.items()})
    return rows.drop("_source", "_total", "n", "total", "processes", "files", "sockets", "relations")


def view_array(view: str, network: list[str], summary: Iterable[str] = SUMMARY) -> Column:
    """Features of a view in the places of the combined one; the other view's are 0."""
    own = {"network": (True, False), "provenance": (False, True), "combined": (True, True)}[view]
    return F.array(*(F.col(c) if own[0] else F.lit(0.0) for c in network), *(F.col(c) if own[1] else F.lit(0.0) for c in summary))


def class_rows(rows: DataFrame, network: list[str], classes: Iterable[str], folds: int) -> DataFrame:
    """Training rows of one-against-rest models: each clean row for each view and class in the folds that may learn from it."""
    views = F.array(*(F.struct(F.lit(v).alias("view"), view_array(v, network).alias("x")) for v in VIEWS))
    long = rows.where("variant = 'clean'").withColumn("_v", F.explode(views)).withColumn("_class", F.explode(F.array(*map(F.lit, classes)))).withColumn("_f", F.explode(F.array(*map(F.lit, range(folds)))))
    long = long.where("_f <> fold")
    return long.select(F.concat_ws("|", "_f", "_v.view", "_class").alias("model"), F.col("_v.x").alias("x"), (F.col("tactic") == F.col("_class")).cast("int").alias("y"), F.lit(1.0).alias("w"))


def posteriors(rows: DataFrame, models: DataFrame, network: list[str], classes: list[str]) -> DataFrame:
    """``case_id, variant`` and one array of class probabilities for each view, from the models of the row's own fold.

    Scores of the one-against-rest models are divided by their sum; a class without a model has probability 0, a view
    without any is uniform.
    """
    from spanlight.operators.fits import score_rows

    views = F.array(*(F.struct(F.lit(v).alias("view"), view_array(v, network).alias("x")) for v in VIEWS))
    long = rows.select("case_id", "variant", "fold", F.explode(views).alias("_v")).withColumn("_class", F.explode(F.array(*map(F.lit, classes))))
    scored = score_rows(long.select("case_id", "variant", F.col("_v.view").alias("view"), "_class", F.concat_ws("|", "fold", "_v.view", "_class").alias("model"), F.col("_v.x").alias("x")), models)
    cell = lambda v, c: F.coalesce(F.max(F.when((F.col("view") == v) & (F.col("_class") == c), F.col("score"))), F.lit(0.0))
    wide = scored.groupBy("case_id", "variant").agg(*(F.array(*(cell(v, c) for c in classes)).alias(v) for v in VIEWS))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    unit = lambda v: F.when(total(F.col(v)) > 0, F.transform(v, lambda x: F.round(x / total(F.col(v)), 12))).otherwise(F.array_repeat(F.lit(1.0 / len(classes)), len(classes)))
    return wide.select("case_id", "variant", *(unit(v).alias(v) for v in VIEWS))


def best(p: Column) -> Column:
    """The place of the largest probability, the first of equals, from 1."""
    return F.array_position(p, F.array_max(p))


def agreement_level(views: list[Column]) -> Column:
    """M7: 2 where all views name one class, 1 where two do, 0 otherwise."""
    return 3 - F.size(F.array_distinct(F.array(*map(best, views))))


def controller_features(rows: DataFrame, classes: list[str]) -> DataFrame:
    """``rows`` (with the three posteriors and ``tactic``) with the features named in ``AGREEMENT`` and ``correct``."""
    c, n, p = (F.col(v) for v in ("combined", "network", "provenance"))
    values = (F.array_max(c), margin(c), entropy(c) / F.log(F.lit(float(len(classes)))), F.array_max(n), margin(n), F.array_max(p), margin(p), js_divergence(n, p), js_divergence(c, n), js_divergence(c, p), (best(n) == best(p)).cast("double"), ((best(n) == best(p)) & (best(n) == best(c))).cast("double"))
    named = F.element_at(F.array(*map(F.lit, classes)), best(c).cast("int"))
    return rows.withColumns(dict(zip(AGREEMENT, values)) | {"correct": (named == F.col("tactic")).cast("int")})


def _masked(names: Iterable[str]) -> Column:
    return F.array(*(F.col(c) if c in set(names) else F.lit(0.0) for c in CONTROLLER))


def accept_inputs(names: Iterable[str] = ("controller", "integrity", "posterior")) -> Column:
    """An array of (name, held-out family, features) for the models that a row is scored by: the controller also without the row's own family."""
    masks = {"controller": CONTROLLER, "integrity": INTEGRITY, "posterior": POSTERIOR}
    own = [F.struct(F.lit(m).alias("name"), F.lit("").alias("held"), _masked(masks[m]).alias("x")) for m in names]
    return F.array(*own, F.struct(F.lit("controller").alias("name"), F.col("variant").alias("held"), _masked(CONTROLLER).alias("x")))


def accept_rows(rows: DataFrame, folds: int) -> DataFrame:
    """Training rows of all accept-or-abstain models: ``model, x, y, w``.

    ``rows`` has ``variant, fold, calibration``, ``correct`` and the controller's features. The controller tells clean and correct rows
    from all others, the integrity model clean rows from corrupted ones, the posterior model correct clean rows from wrong ones;
    a controller more for each family that it never sees. Clean rows share half of the weight, families the other half evenly.
    """
    clean = F.col("variant") == "clean"
    share = lambda n: F.when(clean, 0.5).otherwise(0.5 / n)
    right = (clean & (F.col("correct") == 1)).cast("int")
    entry = lambda name, held, x, y, w, use: F.struct(F.lit(name).alias("name"), F.lit(held).alias("held"), x.alias("x"), y.alias("y"), w.cast("double").alias("w"), use.alias("use"))
    n = len(FAMILIES)
    made = [
        entry("controller", "", _masked(CONTROLLER), right, share(n), F.lit(True)),
        entry("integrity", "", _masked(INTEGRITY), clean.cast("int"), share(n), F.lit(True)),
        entry("posterior", "", _masked(POSTERIOR), F.col("correct"), F.lit(1.0), clean),
        *(entry("controller", f, _masked(CONTROLLER), right, share(n - 1), F.col("variant") != f) for f in FAMILIES),
    ]
    learn = rows.where(F.col("variant").isin("clean", *FAMILIES) & ~F.col("calibration"))
    long = learn.withColumn("_f", F.explode(F.array(*map(F.lit, range(folds))))).where("_f <> fold").withColumn("_m", F.explode(F.array(*made))).where("_m.use")
    return long.select(F.concat_ws("|", "_f", "_m.name", "_m.held").alias("model"), "_m.x", "_m.y", "_m.w")


def accept_scores(rows: DataFrame, models: DataFrame, fold: Column) -> DataFrame:
    """``rows`` with ``controller``, ``integrity``, ``posterior_lr`` and ``held_out`` (the controller that never saw the row's family; null for clean rows), by the models of ``fold``."""
    from spanlight.operators.fits import score_rows

    keys = ["case_id", "variant", "for_fold"]
    asked = rows.withColumn("for_fold", fold)
    long = asked.select(*keys, F.explode(accept_inputs()).alias("_m")).where("_m.held <> 'clean'")
    scored = score_rows(long.select(*keys, F.col("_m.name").alias("name"), F.col("_m.held").alias("held"), F.concat_ws("|", "for_fold", "_m.name", "_m.held").alias("model"), "_m.x"), models)
    pick = lambda name, held: F.max(F.when((F.col("name") == name) & held, F.col("score")))
    plain = F.col("held") == ""
    wide = scored.groupBy(*keys).agg(pick("controller", plain).alias("controller"), pick("integrity", plain).alias("integrity"), pick("posterior", plain).alias("posterior_lr"), pick("controller", ~plain).alias("held_out"))
    return asked.join(wide, keys)


#: Plain summaries of each view that enter the pair features and their products.
PAIR_NETWORK = ("rows_log", "bytes_log", "src_ips_log", "src_ip_hhi", "tcp", "udp")
PAIR_PROVENANCE = ("log_process_candidates", "log_total_entities", "log_relations", "top_rank_score", "rank_score_margin", "top3_time_proximity", "top3_score_mass", "top3_socket_neighbor_count")
PAIR_MODES = ("full", "without_network_posterior", "network_only", "provenance_only")


def pair_features(classes: list[str]) -> dict[str, Column]:
    """M7, M8: what the posteriors and summaries of two views say about each other, for rows of ``controller_features``."""
    n, p = F.col("network"), F.col("provenance")
    both = lambda f: F.aggregate(F.zip_with(n, p, f), F.lit(0.0), lambda a, x: a + x)
    out = {
        "affinity": both(lambda a, b: F.sqrt(a * b)), "js_divergence": js_divergence(n, p), "posterior_l1": both(lambda a, b: F.abs(a - b)), "top_agreement": (best(n) == best(p)).cast("double"),
        "network_confidence": F.array_max(n), "provenance_confidence": F.array_max(p), "network_margin": margin(n), "provenance_margin": margin(p), "network_entropy": entropy(n), "provenance_entropy": entropy(p),
    }
    for k, c in enumerate(classes, 1):
        a, b = F.element_at(n, k), F.element_at(p, k)
        out |= {f"network_p_{c}": a, f"provenance_p_{c}": b, f"posterior_absdiff_{c}": F.abs(a - b), f"posterior_product_{c}": a * b}
    out |= {f"network_s_{c}": F.col(c) for c in PAIR_NETWORK} | {f"provenance_s_{c}": F.col(c) for c in PAIR_PROVENANCE}
    return out | {f"cross_{a}_{b}": F.col(a) * F.col(b) for a in PAIR_NETWORK for b in PAIR_PROVENANCE}


def mode_features(names: Iterable[str], mode: str) -> list[str]:
    """M8: the features that a mode keeps. Without the network's posterior nothing computed from it stays; a single view keeps its own posterior and summaries."""
    if mode not in PAIR_MODES:
        raise ValueError(f"unknown mode: {mode}")
    pair = ("affinity", "js_divergence", "posterior_l1", "top_agreement", "posterior_")
    network = ("network_confidence", "network_margin", "network_entropy", "network_p_")
    own = {"network_only": "network_", "provenance_only": "provenance_"}
    if mode in own:
        return [n for n in names if n.startswith(own[mode])]
    return [n for n in names if mode == "full" or not n.startswith(pair + network)]


def binding_rows(rows: DataFrame, classes: list[str], folds: int) -> tuple[DataFrame, DataFrame]:
    """A case's two views (1) and its network beside a donor's context (0), once for each mode: all pairs, and the training rows of each fold."""
    features = pair_features(classes)
    x = lambda m: F.array(*(features[c].cast("double") for c in mode_features(features, m)))
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), x(m).alias("x")) for m in PAIR_MODES))
    pairs = rows.where("variant in ('clean', 'replace_context')").select("case_id", "variant", "fold", (F.col("variant") == "clean").cast("int").alias("y"), F.explode(modes).alias("_m")).select("case_id", "variant", "fold", "y", "_m.*")
    train = pairs.withColumn("_f", F.explode(F.array(*map(F.lit, range(folds))))).where("_f <> fold")
    return pairs.withColumn("model", F.concat_ws("|", "fold", "mode")), train.select(F.concat_ws("|", "_f", "mode").alias("model"), "x", "y", F.lit(1.0).alias("w"))


def brier_score(p: Column, truth: Column) -> Column:
    """A10: squared distance of a posterior from the true class (``truth`` is its place, from 1)."""
    return F.aggregate(F.transform(p, lambda v, i: F.pow(v - (i + 1 == truth).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, v: a + v)
