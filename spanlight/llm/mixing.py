"""Mixing sources to target weights by iterative proportional fitting (raking) with bounded weights.

Documents are first summed into cells (source, language, topic), which is a partial aggregation
however hot a source is. Raking then scales the cells' token weights in turn until they meet the
target share of every source, every language and every topic of a language. A document is expected
``budget`` times its cell's weight; it comes floor(expected) times, and once more by a draw with the
probability that is left, so the expected tokens of the sample are the raked ones. The draw is a hash
of the document's id, so a repeated run samples the same documents.

No document is expected more than ``copies`` times. A target that would ask for more is lowered to what
its value can give, and the other values of its dimension take over in proportion; where dimensions
together ask for more, the sweeps stop at the bound, and ``marginals`` says what was reached.

A topic is an anchor word of the document's language: the commonest words that are in a tenth of a
language's documents at most are its anchors, and a document has the topic of the one that it says most
often. A topic's target is a share of its language's target, so both can be met. Only DataFrame
functions are used.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.llm.common import documents, free_name, materialize

#: Dimensions, and the columns that tell their values apart.
DIMS = {"source": ["source"], "lang": ["lang"], "topic": ["lang", "topic"]}
#: Sweeps between two tests of the marginals, and sweeps at most.
SWEEPS, MOST_SWEEPS = 6, 60
CLOSE = 1e-9
#: Anchors of a language; languages, those of the most documents first, that have any.
ANCHORS, LANGUAGES = 12, 64
BUDGET, COPIES, TEMPER = 0.6, 2, 0.5
#: Cells up to this number (about 100 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CELLS = 50_000


def _words_like(text: Column, pattern: str) -> Column:
    """The words of a text, as single spaces part them, that match ``pattern`` as a whole, in one pass over it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?<![^ ])(?:{pattern})(?![^ ])"), F.lit(0))


def _content(text: Column) -> Column:
    """Words of four letters or more, of any script."""
    return _words_like(text, r"\p{L}{4,}+")


def anchor_words(docs: DataFrame, text: str = "text", lang: str = "lang", anchors: int = ANCHORS, languages: int = LANGUAGES) -> dict[str, list[str]]:
    """For each language the ``anchors`` content words of the most of its documents, among those in a tenth of them at most; ties to the first word.

    A null language is the empty one. Languages beyond the ``languages`` most frequent have no anchors.
    """
    keyed = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.array_distinct(_content(F.col(text))).alias("words"))
    sizes = keyed.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(languages)
    counted = keyed.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = counted.join(F.broadcast(sizes), "lang").where(F.col("n") * 10 <= F.col("docs"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= anchors)
    out: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "k").collect():
        out.setdefault(r.lang, []).append(r.word)
    return out


def _is(word: Column) -> Callable[[Column], Column]:
    return lambda w: w == word


def topic_of(text: Column, lang: Column, anchors: dict[str, list[str]]) -> Column:
    """The anchor of its language that a text says most often, the first of equals in the order of ``anchors``; ``other`` without one."""
    if not anchors:
        return F.lit("other")
    own = F.create_map(*(x for k, words in anchors.items() for x in (F.lit(k), F.array(*map(F.lit, words)))))[lang]
    every = sorted({w for words in anchors.values() for w in words})

    def most_said(both: Column) -> Column:
        counts = F.transform(both["own"], lambda a, k: F.struct(F.size(F.filter(both["said"], _is(a))).alias("n"), (-k).alias("k"), a.alias("a")))
        best = F.array_max(counts)
        return F.when(best["n"] > 0, best["a"]).otherwise(F.lit("other"))

    # As the one member of an array the words are found once, not once for each anchor.
    said = F.struct(_words_like(text, "|".join(every)).alias("said"), own.alias("own"))
    return F.get(F.transform(F.array(said), most_said), F.lit(0))


def tokens_of(text: Column) -> Column:
    """Words as single spaces part them; at least 1, so that empty documents keep a weight."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1, F.lit(1)).cast("bigint")


def targets_of(cells: DataFrame, dim: str, columns: list[str], within: list[str], bound: float, temper: float) -> DataFrame:
    """The values of a dimension with their ``wanted`` share of all tokens and the ``target`` that bounded weights can give.

    A wanted share is in proportion to the observed share to the power ``temper`` (1 keeps it, 0 makes all
    equal), unless ``cells`` has a column ``weight_<dim>``. Values are compared inside ``within`` (columns of another
    dimension whose targets, ``outer``, ``cells`` already has) or all together. A value cannot have more than ``bound`` times its observed
    share; those that want most beyond it are cut first, and the others share what is left in proportion.
    """
    given = f"weight_{dim}" in cells.columns
    outer = F.first("outer") if within else F.lit(1.0)
    wish = F.first(f"weight_{dim}") if given else F.pow(F.sum("seen"), F.lit(temper))
    values = cells.groupBy(*columns).agg(F.sum("seen").alias("share"), wish.alias("wish"), outer.alias("outer"))
    group = Window.partitionBy(*within)
    values = values.withColumn("wanted", F.coalesce(F.try_divide(F.col("outer") * F.col("wish"), F.sum("wish").over(group)), F.lit(0.0))).withColumn("cap", F.lit(bound) * F.col("share"))
    # A value is cut if what is left for it and those after it, in proportion, is more than it can give.
    before = group.orderBy(F.desc(F.col("wanted") / F.col("cap")), *columns).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = F.try_divide(F.col("outer") - upto("cap"), F.col("outer") - upto("wanted"))
    values = values.withColumn("cut", F.coalesce(level * F.col("wanted") > F.col("cap"), F.col("wanted") > 0))
    lost = lambda c: F.sum(F.when(F.col("cut"), F.col(c)).otherwise(0.0)).over(group)
    rest = F.coalesce(F.try_divide(F.col("outer") - lost("cap"), F.col("outer") - lost("wanted")), F.lit(0.0))
    return values.select(*columns, "wanted", F.when(F.col("cut"), F.col("cap")).otherwise(rest * F.col("wanted")).alias("target"))


def rake(cells: DataFrame, dims: dict[str, list[str]] = DIMS, tokens: str = "tokens", temper: float = TEMPER, most: int = MOST_SWEEPS, bound: float = COPIES / BUDGET) -> DataFrame:
    """``cells`` with ``factor``: raked share over observed share of the cell's tokens, ``bound`` at most.

    A dimension whose columns include those of one before it is nested: its targets are shares of that one's.
    Beside ``factor`` come ``wanted_<dim>`` and ``target_<dim>`` (see ``targets_of``). Sweeps end when all targets are met, or after
    ``most`` where no bounded weights can meet them together.
    """
    out = materialize(cells.withColumn("seen", F.col(tokens) / F.sum(tokens).over(Window.partitionBy()).cast("double")))
    nested: dict[str, list[str]] = {}
    for d, columns in dims.items():
        parents = [p for p, c in nested.items() if set(c) < set(columns) and f"weight_{d}" not in cells.columns]
        found = targets_of(out.withColumn("outer", F.col(f"target_{parents[-1]}")) if parents else out, d, columns, nested[parents[-1]] if parents else [], bound, temper)
        found = found.select(*(F.col(c).alias(f"_{c}") for c in columns), F.col("wanted").alias(f"wanted_{d}"), F.col("target").alias(f"target_{d}"))
        same = functools.reduce(Column.__and__, [out[c].eqNullSafe(F.col(f"_{c}")) for c in columns])
        out = materialize(out.join(found, same).drop(*(f"_{c}" for c in columns)))
        nested[d] = columns
    out = materialize(out.withColumn("raked", F.col("seen")))
    few = out.count() <= BROADCAST_CELLS
    for k in range(1, most + 1):
        if few and k % SWEEPS == 1:  # one task sweeps a small table faster than any exchange
            out = out.coalesce(1)
        for d, columns in dims.items():
            held = F.sum("raked").over(Window.partitionBy(*columns))
            out = out.withColumn("raked", F.least(F.coalesce(F.try_divide(F.col("raked") * F.col(f"target_{d}"), held), F.lit(0.0)), F.lit(bound) * F.col("seen")))
        if k % SWEEPS == 0 or k == most:
            if few:
                out, gap = _swept(out, dims)
            else:
                out = materialize(out)
                gap = largest_gap(out, dims)
            if gap <= CLOSE:
                break
    return out.withColumn("factor", F.col("raked") / F.col("seen"))


def _swept(raked: DataFrame, dims: dict[str, list[str]]) -> tuple[DataFrame, float]:
    """``raked`` (one partition) as a table, with its ``largest_gap``: the task that writes it observes that, so it costs no job."""
    seen, gap = Observation(), free_name(raked, "gap")
    gaps = [F.abs(F.sum("raked").over(Window.partitionBy(*columns)) - F.col(f"target_{d}")) for d, columns in dims.items()]
    stored = materialize(raked.withColumn(gap, F.greatest(*gaps, F.lit(0.0))).observe(seen, F.max(gap).alias("gap")).drop(gap))
    return stored, seen.get.get("gap") or 0.0


def marginals(raked: DataFrame, dims: dict[str, list[str]] = DIMS) -> DataFrame:
    """``dim, value, wanted, target, reached``: what each value's share should be, what bounded weights can give it, and what it came to."""
    value = lambda columns: F.array(*(F.col(c).cast("string") for c in columns))
    parts = [raked.groupBy(F.lit(d).alias("dim"), value(c).alias("value")).agg(F.first(f"wanted_{d}").alias("wanted"), F.first(f"target_{d}").alias("target"), F.sum("raked").alias("reached")) for d, c in dims.items()]
    return functools.reduce(DataFrame.union, parts)


def largest_gap(raked: DataFrame, dims: dict[str, list[str]] = DIMS) -> float:
    """How far the value that meets its target worst is from it."""
    return marginals(raked, dims).agg(F.coalesce(F.max(F.abs(F.col("reached") - F.col("target"))), F.lit(0.0))).first()[0]


def describe(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with topic, tokens and the values of source and language to be raked, and what those columns are called."""
    names = {k: free_name(docs, k) for k in ("topic", "tokens", "weight", "copies", "mix_source", "mix_lang")}
    language = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    keyed = docs.withColumns(
        {
            names["mix_source"]: F.coalesce(F.col(source).cast("string"), F.lit("")),
            names["mix_lang"]: language,
            names["topic"]: topic_of(F.col(text), language, anchor_words(docs, text, lang)),
            names["tokens"]: tokens_of(F.col(text)),
        }
    )
    return keyed, names


def cells_of(keyed: DataFrame, names: dict[str, str], targets: DataFrame | None = None) -> DataFrame:
    """Tokens of each cell; ``targets`` (``dim, value, weight``) gives the weights of the values of the dimensions that it names, 0 to those left out."""
    cells = keyed.groupBy(F.col(names["mix_source"]).alias("source"), F.col(names["mix_lang"]).alias("lang"), F.col(names["topic"]).alias("topic")).agg(F.sum(names["tokens"]).alias("tokens"))
    for d in [r.dim for r in targets.select("dim").distinct().collect()] if targets is not None else []:
        wanted = targets.where(F.col("dim") == d).select(F.col("value").alias(d), F.col("weight").cast("double").alias(f"weight_{d}"))
        cells = cells.join(F.broadcast(wanted), d, "left").fillna(0.0, [f"weight_{d}"])
    return materialize(cells)


def dimensions(targets: DataFrame | None = None) -> dict[str, list[str]]:
    """Topics are values of their languages, but where their weights are given they are told apart by themselves."""
    free = targets is not None and not targets.where("dim = 'topic'").isEmpty()
    return DIMS | ({"topic": ["topic"]} if free else {})


def calibrate(keyed: DataFrame, names: dict[str, str], id: str = "doc_id", budget: float = BUDGET, seed: str = "mix", targets: DataFrame | None = None, copies: int = COPIES) -> DataFrame:
    """What ``describe`` gave, with the weight of each document and the copies of it that the sample holds, ``copies`` at most.

    Null sources and languages are a value of their own; a null or empty text is one token of
    topic ``other``; repeated rows share their draw; an empty table gives an empty result.
    ``targets`` (``dim, value, weight``) replaces the tempered targets of the dimensions that it
    names; their other values are never drawn.
    """
    cells = rake(cells_of(keyed, names, targets), dimensions(targets), bound=copies / budget)
    raked = materialize(cells.select("source", "lang", "topic", F.round("factor", 6).alias("factor")))
    raked = raked.select(*(F.col(c).alias(f"cell_{c}") for c in raked.columns))
    small = F.broadcast(raked) if raked.count() <= BROADCAST_CELLS else raked
    # No key is null; a plain equality would have the topics found once more, to test them for nulls.
    same = keyed[names["mix_source"]].eqNullSafe(raked.cell_source) & keyed[names["mix_lang"]].eqNullSafe(raked.cell_lang) & keyed[names["topic"]].eqNullSafe(raked.cell_topic)
    out = keyed.join(small, same).withColumn(names["weight"], F.col("cell_factor"))
    times = F.least(F.col(names["weight"]) * budget, F.lit(float(copies)))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    out = out.withColumn(names["copies"], (F.floor(times) + (draw < times - F.floor(times)).cast("bigint")).cast("int"))
    return out.drop("cell_source", "cell_lang", "cell_topic", "cell_factor")


def sample_mixture(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", budget: float = BUDGET, seed: str = "mix", targets: DataFrame | None = None, copies: int = COPIES) -> DataFrame:
    """The rows of ``docs`` that the calibrated draw keeps, each as often as it was drawn, with their columns as they were.

    Nulls, empty texts, repeated rows and empty tables are as in ``calibrate``; columns may have
    any names.
    """
    keyed, names = describe(docs, text, source, lang)
    out = calibrate(keyed, names, id, budget, seed, targets, copies)
    times = F.col(names["copies"])
    return out.where(times > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(True), times)).alias(names["weight"])).select(docs.columns)


def op7_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, names = describe(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    # Without the texts the described documents are small, and they are read twice.
    out = calibrate(materialize(keyed.drop("text")), names)
    return out.select("doc_id", "source", "lang", "topic", "tokens", "weight", "copies")


def _oracle(sweeps: int = MOST_SWEEPS) -> str:
    bound = COPIES / BUDGET
    parts = [
        """x AS (SELECT doc_id, source, lang, coalesce(source, '') AS s_source, coalesce(lang, '') AS s_lang, string_split(coalesce(text, ''), ' ') AS words,
  coalesce(length(text) - length(replace(text, ' ', '')) + 1, 1)::BIGINT AS tokens FROM documents)""",
        "v AS (SELECT s_lang, word, count(*) AS n FROM (SELECT s_lang, unnest(list_distinct(list_filter(words, lambda w: regexp_full_match(w, '\\p{L}{4,}')))) AS word FROM x) GROUP BY ALL)",
        f"a AS (SELECT s_lang, word, k FROM (SELECT s_lang, word, row_number() OVER (PARTITION BY s_lang ORDER BY n DESC, word) AS k FROM v JOIN (SELECT s_lang, count(*) AS docs FROM x GROUP BY 1) USING (s_lang) WHERE n * 10 <= docs) WHERE k <= {ANCHORS})",
        "s AS (SELECT doc_id, s_lang, word, count(*) AS n FROM (SELECT doc_id, s_lang, unnest(words) AS word FROM x) SEMI JOIN a USING (s_lang, word) GROUP BY ALL)",
        "b AS (SELECT doc_id, arg_min(word, (-n, k)) AS word FROM s JOIN a USING (s_lang, word) GROUP BY doc_id)",
        "d AS (SELECT x.*, coalesce(b.word, 'other') AS s_topic FROM x LEFT JOIN b USING (doc_id))",
        "c AS (SELECT s_source, s_lang, s_topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "r AS (SELECT s_source, s_lang, s_topic, tokens / sum(tokens) OVER () AS seen FROM c)",
    ]
    # Targets: tempered shares, cut to what bounded weights can give; those of topics are shares of their language's.
    keys = {"source": "s_source", "lang": "s_lang", "topic": "s_lang, s_topic"}
    for dim, cols in keys.items():
        within = "PARTITION BY s_lang" if dim == "topic" else ""
        outer = "(SELECT target FROM t_lang z WHERE z.s_lang = r.s_lang)" if dim == "topic" else "1.0::DOUBLE"
        parts += [
            f"g_{dim} AS (SELECT *, room * wish / sum(wish) OVER ({within}) AS wanted, {bound!r} * share AS cap FROM (SELECT {cols}, sum(seen) AS share, pow(sum(seen), {TEMPER}) AS wish, any_value({outer}) AS room FROM r GROUP BY {cols}))",
            f"h_{dim} AS (SELECT *, (room - coalesce(sum(cap) OVER w, 0)) / nullif(room - coalesce(sum(wanted) OVER w, 0), 0) * wanted > cap AS over_cap FROM g_{dim} WINDOW w AS ({within} ORDER BY wanted / cap DESC, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"t_{dim} AS MATERIALIZED (SELECT {cols}, CASE WHEN coalesce(over_cap, true) THEN cap ELSE wanted * (room - sum(CASE WHEN coalesce(over_cap, true) THEN cap ELSE 0 END) OVER ({within})) / (room - sum(CASE WHEN coalesce(over_cap, true) THEN wanted ELSE 0 END) OVER ({within})) END AS target FROM h_{dim})",
        ]
    parts.append("w0 AS MATERIALIZED (SELECT *, seen AS w FROM r)")
    k = 0
    for _ in range(sweeps):
        for dim, cols in keys.items():
            on = " AND ".join(f"a.{c} = t.{c}" for c in cols.split(", "))
            own = ", ".join(f"a.{c}" for c in cols.split(", "))
            parts.append(
                f"w{k + 1} AS MATERIALIZED (SELECT a.s_source, a.s_lang, a.s_topic, a.seen, least(coalesce(a.w * t.target / nullif(sum(a.w) OVER (PARTITION BY {own}), 0), 0), {bound!r} * a.seen) AS w FROM w{k} a JOIN t_{dim} t ON {on})"
            )
            k += 1
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
f AS (SELECT s_source, s_lang, s_topic, round(w / seen, 6) AS weight FROM w{k}),
p AS (SELECT d.*, f.weight, least(f.weight * {BUDGET}, {float(COPIES)}) AS times FROM d JOIN f USING (s_source, s_lang, s_topic))
SELECT doc_id, source, lang, s_topic AS topic, tokens, weight,
  (floor(times) + (('0x' || substring(md5(concat_ws('|', doc_id::VARCHAR, 'mix')), 1, 8))::BIGINT / 4294967296.0 < times - floor(times))::INT)::INT AS copies FROM p"""
    )


OP7_SQL = _oracle()
