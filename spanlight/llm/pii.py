r"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are e-mail and IP addresses, payment cards and phone numbers, found by pattern
in every whole text. What surrounds them can give them away, too: the corpus says how much. Words
are folded: letters are small, and what is neither letter nor digit at their ends is cut off. For
the words next to entities of a kind, c is in how many texts a word stands there, n in how many it
stands anywhere, C how many words stand next to that kind and N how many words there are. A word
discloses the kind with

    PMI = log2(p / (C / N)) bits, of the IC = -log2(C / N) bits that it has,

where p is not c / n but the lower end of its confidence interval (Wilson's, wider where more
words are tried), so a word met a few times shows little. Equal texts count once, and so do equal
surroundings of an entity: copies of a text, or of a passage, are one piece of evidence.

A word is disclosive if it takes at least ``disclosure`` of the IC and c is at least ``support``.
In every document, whether it holds an entity or not, disclosive words become spans of kind
``term``, however they are written; the pattern spans stay as they are. Counts go over all texts.
Candidate words are broadcast up to a checked number; beyond it word counts are aggregated first
and joined by a shuffle. Places are running sums and what stands around them is cut out of blocks
of a text, so the work grows with the length of a text and not with its square, however many
entities it holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm.common import BROADCAST_KEYS, documents, free_name, materialize

_GAP = r"\x20\x09-\x0D"
_NAME = "A-Za-z0-9._%+-"
#: Possessive forms of the patterns: the same matches in time linear in the text. An e-mail match
#: starts where a run of name characters does or where the match before it ended; a card needs 12 digits.
PATTERNS = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
SPAN = "array<struct<start:int,kind:int,end:int>>"
BROADCAST_TERMS = 200_000
#: A word without what stands around it: from its first letter or digit to its last.
CORE = rf"[\p{{L}}\p{{N}}](?:[^{_GAP}]*[\p{{L}}\p{{N}}])?"
#: Least half width of the confidence interval, in standard errors.
ERRORS = 1.645


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        bare = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(bare, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255"))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checker(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["hit"])


def _scan(values: Column, join: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """Running ``join`` of an array's values, by doubling: log n passes over it."""

    def step(acc: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(neutral, far), F.slice(acc, F.lit(1), F.size(acc) - far)), join)

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)
    return F.when(F.size(values) > 1, F.aggregate(passes, values, step)).otherwise(values)


def _located(text: Column, pattern: Column, kind: int) -> Column:
    """Structs (start, kind, end, hit) of all matches: what stands between the matches gives their places."""
    hits, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda h, b: F.length(h) + F.length(b))
    ends = _scan(sizes, lambda x, y: x + y, F.lit(0))
    return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), h.alias("hit")))


#: Code points of a block.
BLOCK = 1024


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of the text of ``blocks``, read from the blocks that hold them."""
    a = F.greatest(start, F.lit(0)).cast("int")
    first = F.floor(a / BLOCK).cast("int")
    many = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    part = F.array_join(F.slice(blocks, first + 1, many), "")
    return F.when(end > a, F.substr(part, a - first * BLOCK + 1, end - a)).otherwise(F.lit(""))


def base_spans(text: Column) -> Column:
    """The pattern spans of a text, by start and then kind; empty where there are none."""
    none = F.expr(f"cast(array() as {SPAN})")
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        valid = F.filter(_located(text, F.lit(pattern), k), _checker(kind))
        bare = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        hint = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else F.lit(True)
        found.append(F.when(hint & text.rlike(pattern), bare).otherwise(none))
    return F.coalesce(F.array_sort(F.concat(*found)), none)


def _word_like(term: Column) -> Column:
    return term.rlike(r"\p{L}{2}")


def _folded(word: Column) -> Column:
    return F.lower(F.regexp_extract(word, CORE, 0))


def _terms_of(text: Column) -> Column:
    """The distinct folded words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CORE), F.lit(0)), F.lower))


def _least_share(c: Column, n: Column, errors: float) -> Column:
    """The lower end of Wilson's interval of the share c / n."""
    p, z = c / n, errors * errors
    return (p + z / (2 * n) - errors * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` (``text``) with ``share``: one over the number of rows with that text."""
    mark = F.xxhash64("text")
    again = materialize(docs.groupBy(mark.alias("mark")).agg(F.count("*").alias("rows")).where("rows > 1"))
    many = again.count()
    if not many:
        return docs.withColumn("share", F.lit(1.0))
    joined = docs.join(F.broadcast(again) if many <= BROADCAST_KEYS else again, mark == again["mark"], "left")
    return joined.select("text", F.coalesce(1 / F.col("rows"), F.lit(1.0)).alias("share"))


def disclosive_terms(docs: DataFrame, found: DataFrame, reach: int = 4, support: int = 3, disclosure: float = 0.8) -> DataFrame:
    """``(kind, term)`` of all disclosive words.

    ``docs`` has every ``text``; ``found`` has ``text`` and ``spans`` of those with entities.
    """
    width = 40 * reach
    blocked = found.withColumn("mark", F.xxhash64("text")).withColumn("blocks", _blocks(F.col("text")))

    def beside_of(s: Column) -> Column:
        # One more character on either side says whether the cut falls inside a word.
        left, right = _cut(F.col("blocks"), s["start"] - width - 1, s["start"]), _cut(F.col("blocks"), s["end"], s["end"] + width + 1)
        return F.struct(s["kind"].alias("kind"), left.alias("left"), right.alias("right"))

    near = blocked.select("mark", F.explode(F.transform("spans", beside_of)).alias("s"))
    full_left, full_right = F.length("s.left") > width, F.length("s.right") > width
    left = F.split(F.when(full_left, F.substr("s.left", F.lit(2))).otherwise(F.col("s.left")), f"[{_GAP}]+")
    right = F.split(F.substr("s.right", F.lit(1), F.lit(width)), f"[{_GAP}]+")
    # The words that touch the entity are incomplete, and so is one that the edge of what was cut out falls in.
    split_left = full_left & F.substr("s.left", F.lit(1), F.lit(1)).rlike(f"[^{_GAP}]")
    split_right = full_right & F.substr("s.right", F.lit(width + 1), F.lit(1)).rlike(f"[^{_GAP}]")
    begin = F.greatest(F.when(split_left, 2).otherwise(1), F.size(left) - reach)
    many = F.size(right) - F.when(split_right, 2).otherwise(1)
    words = F.concat(F.slice(left, begin, F.greatest(F.size(left) - begin, F.lit(0))), F.slice(right, 2, F.least(F.lit(reach), F.greatest(many, F.lit(0)))))
    around = near.select(F.col("s.kind").alias("kind"), "mark", F.transform(words, _folded).alias("words"))
    seen = around.select("kind", "mark", F.xxhash64("words").alias("place"), F.explode("words").alias("term")).where(_word_like(F.col("term")))
    evidence = F.least(F.count_distinct("mark"), F.count_distinct("place"))
    beside = materialize(seen.groupBy("kind", "term").agg(evidence.alias("near_n"), F.count("*").alias("rows")))
    wanted = beside.where(F.col("near_n") >= support)
    tried = wanted.count()
    spread = _once(docs).select("share", F.explode(_terms_of(F.col("text"))).alias("term"))
    texts = F.round(F.sum("share")).alias("all_n")
    if tried <= BROADCAST_TERMS:
        counts = spread.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(texts)
    else:
        counts = spread.groupBy("term").agg(texts).join(wanted.select("term").distinct(), "term", "left_semi")
    text = F.col("text")
    spaces = F.length(text) - F.length(F.translate(text, " \t\n\r\x0b\x0c", ""))
    whole = docs.agg(F.sum(spaces + 1).cast("double").alias("words"))
    kinds = beside.groupBy("kind").agg(F.sum("rows").alias("kind_n"))
    beside_any = F.col("kind_n") / F.col("words")
    share = _least_share(F.least(F.col("near_n"), F.col("all_n")), F.col("all_n"), max(ERRORS, math.sqrt(math.log(max(tried, 1)))))
    ic, pmi = -F.log2(beside_any), F.log2(share / beside_any)
    return (
        wanted.join(counts, "term").join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(whole))
        .where(pmi >= disclosure * ic)
        .select("kind", "term")
    )


def find_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", reach: int = 4, support: int = 3, disclosure: float = 0.8) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and what they are called: the pattern spans and all spans.

    Both are arrays of start, kind and end, empty where nothing was found. Null text counts as empty.
    """
    safe = F.coalesce(F.col(text), F.lit(""))
    base, spans = free_name(docs, "base"), free_name(docs, "spans")
    marked = docs.withColumn(base, base_spans(safe))
    found = materialize(marked.where(F.size(base) > 0).select(F.col(text).alias("text"), F.col(base).alias("spans")))
    terms = materialize(disclosive_terms(docs.select(safe.alias("text")), found, reach, support, disclosure).select("term").distinct())
    listed = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    mark = F.xxhash64(safe)  # an id may have several texts
    # The hash is taken before words become rows; after it every word would hash the whole text.
    worded = docs.select(F.col(id).alias("span_id"), mark.alias("span_mark"), _terms_of(safe).alias("words"))
    held = worded.select("span_id", "span_mark", F.explode("words").alias("term")).join(listed, "term", "left_semi")
    per_doc = held.groupBy("span_id", "span_mark").agg(F.collect_set("term").alias("span_terms"))
    joined = marked.join(per_doc, marked[id].eqNullSafe(per_doc["span_id"]) & (mark == per_doc["span_mark"]), "left")
    terms_here = _words_among(safe, F.col("span_terms"))
    every = free_name(joined, "every")
    joined = joined.withColumn(every, F.when(F.col("span_terms").isNull(), F.col(base)).otherwise(F.array_sort(F.concat(F.col(base), terms_here))))
    joined = joined.withColumn(spans, F.when(F.col("span_terms").isNull(), F.col(every)).otherwise(_free_of_base(F.col(every))))
    return joined.drop("span_id", "span_mark", "span_terms", every), base, spans


def _words_among(text: Column, terms: Column) -> Column:
    """Term spans of the words of a text that are among ``terms``: both are sorted together, and a word's term stands right before it."""
    of_words = F.transform(_located(text, F.lit(CORE), len(PATTERNS)), lambda s: F.struct(F.lower(s["hit"]).alias("hit"), F.lit(1).alias("word"), s["start"].alias("start"), s["end"].alias("end")))
    of_terms = F.transform(terms, lambda t: F.struct(t.alias("hit"), F.lit(0).alias("word"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    entries = F.array_sort(F.concat(of_words, of_terms))
    last = _scan(F.transform(entries, lambda e: F.when(e["word"] == 0, e["hit"])), lambda x, y: F.coalesce(x, y), F.lit(None).cast("string"))
    span = lambda e: F.struct(e["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), e["end"].alias("end"))
    return F.filter(F.zip_with(entries, last, lambda e, t: F.when((e["word"] == 1) & (e["hit"] == t), span(e))), lambda s: s.isNotNull())


def _free_of_base(spans: Column) -> Column:
    """Sorted spans without the terms that overlap a pattern span: those before end by its start, those after start from its end on."""
    term, far = len(PATTERNS), F.lit(2**31 - 1)
    before = _scan(F.transform(spans, lambda s: F.when(s["kind"] < term, s["end"]).otherwise(F.lit(0))), lambda x, y: F.greatest(x, y), F.lit(0))
    after = F.reverse(_scan(F.reverse(F.transform(spans, lambda s: F.when(s["kind"] < term, s["start"]).otherwise(far))), lambda x, y: F.least(x, y), far))
    kept = F.zip_with(spans, F.arrays_zip(before.alias("b"), after.alias("a")), lambda s, o: F.when((s["kind"] < term) | (o["b"] <= s["start"]) & (o["a"] >= s["end"]), s))
    return F.filter(kept, lambda s: s.isNotNull())


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k


def _written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, a digest of the pattern spans and all spans of each row of ``docs``.

    Null and empty texts have no spans; repeated rows come as often as they are, and rows that
    share an id are told apart by their texts; other columns are ignored, whatever their names;
    an empty table stays empty.
    """
    every, _, _ = find_spans(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return every.select(F.col("doc_id").alias(id), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def sanitize(docs: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span generalised to its kind in brackets; a ``length`` column follows the new text.

    Spans that overlap become one. Rows without spans are as they were, null texts too. Repeated
    rows change alike; all columns stay, whatever their names; an empty table stays empty.
    """
    every, _, spans = find_spans(docs, id, text)
    name, body = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), F.col(text)
    blocks, ends = free_name(every, "blocks"), free_name(every, "ends")
    every = every.withColumn(blocks, F.when(F.size(spans) > 0, _blocks(body)))
    every = every.withColumn(ends, _scan(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y), F.lit(0)))

    def piece(s: Column, i: Column) -> Column:
        done = F.coalesce(F.get(ends, i - 1), F.lit(0))
        return F.when(s["start"] >= done, F.concat(_cut(F.col(blocks), done, s["start"]), F.get(name, s["kind"]))).otherwise(F.lit(""))

    new = F.concat(F.array_join(F.transform(spans, piece), ""), _cut(F.col(blocks), F.array_max(ends), F.length(body)))
    some = F.size(spans) > 0
    changed = every.withColumn(text, F.when(some, new).otherwise(body))
    if length and length in docs.columns:
        changed = changed.withColumn(length, F.when(some, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return changed.select(docs.columns)


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
