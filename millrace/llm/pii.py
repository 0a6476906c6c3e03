"""Personal data: fixed patterns, and terms that reveal a protected value, in DataFrame operations only.

Values that the patterns find are protected. Terms are judged by how much they tell of a value that
stands near them. Texts are cut into passages (sentences, and long ones into pieces of
``PASSAGE`` words). In a text, a term of the same passage as a value supports it with weight
``min(1, NEAR / words of the passage)``: in a long passage words meet by chance. Over the corpus, the support of
all texts divided by the number of texts with the term estimates how likely a reader who meets the
term is right to think of the value. The lower bound of that share (Wilson, 95 %) counts, so a single text
is weak evidence and copies of one passage are no more than one. Its negative logarithm is what
the reader still does not know about the value, in bits. A term that leaves at most ``GENERALISE`` bits
is replaced by its class in all texts, one that leaves at most ``REMOVE`` is removed, if it also tells
at least ``TELLS`` bits more than the value's own share of the texts. None of this depends on the
size of the corpus, and a term that many texts hold without the value never qualifies.

A telling term that stands nowhere but near values is known with its texts already; only for the
others are the words of all texts searched.

Cases: a null text is empty. Spans are code points, the end exclusive; patterns of one kind do not overlap, but
those of two kinds may. Null ids and repeated rows are kept as they are. An empty table gives no
rows. Other columns stay, whatever their names. A sentence of more than ``PASSAGE`` words may be cut inside
a value that holds spaces; the value is masked all the same, and judged by its other places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import text_or_empty
from millrace.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")

# What the patterns match. Possessive groups and look-behinds match the same as the plain
# forms, but neither recurse nor start again inside a run that has failed.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of these has no match of the pattern.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

# A term: two or more letters and digits, with a letter first.
TERM = r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}\p{N}]+"
# Where a passage ends: no base value goes on beyond it. A word is cut after 100 signs.
PASSAGE_END = r"\n|(?<=[.!?])\s+(?=\p{Lu})"
PASSAGE = 40
PIECE = rf"(?:\S{{1,100}}\s*){{1,{PASSAGE}}}"
# So many words are near one another for sure.
NEAR = 20
# Bits that a term leaves open at most, and bits that it tells at least.
GENERALISE, REMOVE, TELLS = 2.5, 1.0, 1.0
# Normal quantile of the lower bound.
Z = 1.96

# Doublings of a running sum: an array holds fewer than 2^31 matches.
DOUBLINGS = 31

# What stands for a base span.
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")

TERM_SPANS = "array<struct<start:int,end:int,remove:boolean>>"
SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(numbers: Column) -> Column:
    """Sums of an array's beginnings, in a number of passes that is the logarithm of its length."""
    for k in range(DOUBLINGS):
        numbers = _bound(numbers, _add_earlier(1 << k))
    return numbers


def _add_earlier(step: int):
    """Add to each number the one ``step`` places before it."""

    def once(a: Column) -> Column:
        more = F.transform(a, lambda x, i: x + F.when(i >= step, F.get(a, i - step)).otherwise(F.lit(0)))
        return F.when(F.size(a) > step, more).otherwise(a)

    return once


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, F.coalesce(F.nullif(p, F.lit("")), F.lit("0")).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans_of(text: Column, pattern: str, kind: int, valid) -> Column:
    """Matches of one pattern with their places: the text is cut at the matches and lengths are summed."""
    empty = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def build(g: Column) -> Column:
            lengths = F.zip_with(F.slice(g, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))

            def spans(ends: Column) -> Column:
                every = F.transform(
                    found,
                    lambda value, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (F.get(ends, i) - F.length(value)).alias("start"),
                        F.get(ends, i).alias("end"),
                        value.alias("value"),
                    ),
                )
                return F.filter(every, lambda s: valid(s["value"])).cast(f"array<{SPAN}>")

            return _bound(running_sum(lengths), spans)

        return F.when(F.size(found) > 0, _bound(gaps, build)).otherwise(empty)

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by kind as listed and then by start."""
    empty = F.array().cast(f"array<{SPAN}>")
    parts = []
    for number, kind in enumerate(KINDS[:-1]):
        spans = _spans_of(text, PATTERNS[kind], number, lambda v, kind=kind: _valid(kind, v))
        parts.append(F.when(F.rlike(text, F.lit(NEEDS[kind])), spans).otherwise(empty))
    return F.concat(*parts)


def keyed_spans(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``k_id, k_text, base, held`` of every text.

    ``k_text`` tells texts apart; ``held`` is the text itself where it has base spans.
    """
    text = text_or_empty(column)
    rows = docs.select(F.col(f"`{key}`").alias("k_id"), F.xxhash64(text).alias("k_text"), base_spans(text).alias("base"), text.alias("text"))
    return rows.select("k_id", "k_text", "base", F.when(F.size("base") > 0, F.col("text")).alias("held"))


def _terms(text: Column) -> Column:
    """Terms of a text outside its addresses; no other base value holds letters."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0))


def passages(found: DataFrame) -> DataFrame:
    """``k_text, rows, passage, weight, values, terms`` of the passages that hold a value.

    ``rows`` is how many rows have this text, ``passage`` a hash of the passage.
    """
    texts = found.where("held IS NOT NULL").groupBy("k_text").agg(F.count(F.lit(1)).alias("rows"), F.any_value("held").alias("held"))
    cut = F.flatten(F.transform(F.split("held", PASSAGE_END), lambda s: F.regexp_extract_all(s, F.lit(PIECE), F.lit(0))))
    one = texts.select("k_text", "rows", F.explode(cut).alias("text"))
    some = F.lit(False)
    for pattern in NEEDS.values():
        some = some | F.rlike("text", F.lit(pattern))
    one = one.where(some).select("*", base_spans(F.col("text")).alias("base"), _terms(F.col("text")).alias("all"))
    return one.where(F.size("base") > 0).select(
        "k_text",
        "rows",
        F.xxhash64("text").alias("passage"),
        F.least(F.lit(1.0), NEAR / F.greatest(F.size("all"), F.lit(1))).alias("weight"),
        F.array_distinct(F.transform("base", lambda s: F.lower(s["value"]))).alias("values"),
        F.array_distinct("all").alias("terms"),
    )


def lower_bound(share: Column, n: Column) -> Column:
    """The lower end of the Wilson interval of a share seen in n cases."""
    z2 = Z * Z
    spread = Z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return (share + z2 / (2 * n) - spread) / (1 + z2 / n)


def text_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """``term, with_term``: in how many rows every term of the corpus stands."""
    words = docs.select(F.explode(F.array_distinct(_terms(text_or_empty(column)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))


def disclosing_terms(docs: DataFrame, found: DataFrame, near: DataFrame, column: str = "text") -> DataFrame:
    """``value, term, with_term, left``: the terms that tell enough of a value, and the bits they leave open."""
    total = found.count()
    each = near.select("k_text", "rows", "passage", "weight", "terms", F.explode("values").alias("value"))
    values = each.select("k_text", "rows", "value").distinct().groupBy("value").agg(F.sum("rows").alias("with_value"))
    pairs = each.select("k_text", "rows", "passage", "weight", "value", F.explode("terms").alias("term"))
    # A text supports a pair by its nearest passage.
    texts = pairs.groupBy("k_text", "value", "term", "rows").agg(F.max(F.struct("weight", "passage")).alias("best"))
    support = texts.groupBy("value", "term", "best.passage").agg(
        F.sum(F.col("rows") * F.col("best.weight")).alias("support"), F.sum("rows").alias("rows")
    )
    support = support.groupBy("value", "term").agg(
        F.sum("support").alias("support"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("different")
    )
    judged = support.join(text_counts(docs, column), "term").join(values, "value")
    # Copies of a passage bring no evidence: the number of cases shrinks by the copies that a passage has.
    cases = F.col("with_term") * F.col("different") / F.col("rows")
    bound = lower_bound(F.least(F.lit(1.0), F.col("support") / F.col("with_term")), cases)
    told = F.log2(bound * F.lit(float(total)) / F.col("with_value"))
    judged = judged.select("value", "term", "with_term", (-F.log2(bound)).alias("left"), told.alias("told"))
    return judged.where((F.col("left") <= GENERALISE) & (F.col("told") >= TELLS)).drop("told")


def term_spans(docs: DataFrame, found: DataFrame, column: str = "text") -> DataFrame:
    """``k_text, terms``: the terms to replace in every text that has some, by start.

    A telling term is replaced wherever it stands outside base spans, in texts without its value too.
    """
    near = cut_lineage(passages(found))
    every = cut_lineage(disclosing_terms(docs, found, near, column))
    telling = every.groupBy("term", "with_term").agg((F.min("left") <= REMOVE).alias("remove"))
    beside = near.select("k_text", "rows", F.explode("terms").alias("term")).distinct().join(telling, "term")
    beside = cut_lineage(beside)
    known = beside.groupBy("term").agg(F.sum("rows").alias("rows"))
    far = telling.join(known, "term").where(F.col("with_term") > F.col("rows")).select("term", "remove")
    far = cut_lineage(far)
    text = text_or_empty(column)
    places = beside.select("k_text", "term", "remove")
    texts = found.where("held IS NOT NULL").select("k_text", "base", F.col("held").alias("text"))
    if not far.isEmpty():
        rows = docs.select(F.xxhash64(text).alias("k_text"), F.array_distinct(_terms(text)).alias("all"))
        others = cut_lineage(rows.select("k_text", F.explode("all").alias("term")).join(far, "term").distinct())
        places = places.unionByName(others)
        # Texts without values that hold such a term are read again for it.
        plain = others.select("k_text").distinct().join(texts.select("k_text"), "k_text", "left_anti")
        read = docs.select(F.xxhash64(text).alias("k_text"), text.alias("text")).join(cut_lineage(plain), "k_text")
        texts = texts.unionByName(read.withColumn("base", F.array().cast(f"array<{SPAN}>")))
    named = places.distinct().groupBy("k_text").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("named"))
    once = texts.groupBy("k_text").agg(F.any_value("base").alias("base"), F.any_value("text").alias("text"))
    spans = F.transform(
        _spans_of(F.col("text"), TERM, len(KINDS) - 1, lambda v: F.map_contains_key("named", F.lower(v))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at("named", F.lower(s["value"])).alias("remove")),
    )
    free = F.filter(spans, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return cut_lineage(once.join(named, "k_text").select("k_text", free.alias("terms")).where(F.size("terms") > 0))


def count_kind(spans: str, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number))


def span_text(spans: Column, kind: str | None = None) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = (lambda s: F.lit(kind)) if kind else (lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``k_id, base, terms`` for every row of ``docs``."""
    found = cut_lineage(keyed_spans(docs, key, column))
    terms = term_spans(docs, found, column)
    none = F.array().cast(TERM_SPANS)
    return found.drop("held").join(terms, "k_text", "left").select("k_id", "base", F.coalesce("terms", none).alias("terms"))


def _masked(text: Column, base: Column, terms: Column) -> Column:
    """The text with all spans replaced; spans that overlap are replaced as one, by the mask of the first."""
    masks = F.array(*[F.lit(m) for m in MASKS])
    fixed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.element_at(masks, b["kind"] + 1).alias("mask")))
    soft = F.transform(
        terms,
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["remove"], F.lit("")).otherwise(F.lit("[TERM]")).alias("mask")),
    )
    spans = F.array_sort(F.concat(fixed, soft))

    def rebuild(signs: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def add(state: Column, span: Column) -> Column:
            gap = F.array_join(F.slice(signs, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0))), "")
            more = F.array(gap, F.when(span["start"] >= state["at"], span["mask"]).otherwise(F.lit("")))
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], more).alias("out"))

        def end(state: Column) -> Column:
            rest = F.slice(signs, state["at"] + 1, F.greatest(F.size(signs) - state["at"], F.lit(0)))
            return F.concat(F.array_join(state["out"], ""), F.array_join(rest, ""))

        return F.aggregate(spans, begin, add, end)

    # Signs are code points, so that a slice costs its own length.
    signs = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(F.size(spans) > 0, _bound(signs, rebuild)).otherwise(text)


def sanitise(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``docs`` with personal data and telling terms replaced in the text; other columns stay.

    Texts without any keep their value, null included.
    """
    found = cut_lineage(keyed_spans(docs, key, column))
    terms = term_spans(docs, found, column)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = text_or_empty(column)
    rows = docs.select(own.alias("row"), F.xxhash64(text).alias("k_text"), base_spans(text).alias("base"))
    spans = F.coalesce("terms", F.array().cast(TERM_SPANS))
    value = F.col("row")[column]
    clean = (F.size("base") == 0) & (F.size(spans) == 0)
    new = F.when(clean, value).otherwise(_masked(F.coalesce(value.cast("string"), F.lit("")), F.col("base"), spans))
    joined = rows.join(terms, "k_text", "left")
    return joined.select(*[new.alias(c) if c == column else F.col("row")[c].alias(c) for c in docs.columns])
