"""Benchmark decontamination by winnowed fingerprints, in DataFrame operations only.

Words are hashed in k-grams; every window of w consecutive k-grams keeps its smallest hash. Two
texts that share k + w - 1 words in a row therefore share a kept hash, so joining the
fingerprints of documents and benchmark items misses no shared window of that many words. Hits
are then extended: each window around a hit is compared word by word with the items' windows.
With k = 5 and w = 6 the guarantee covers windows of 10 words. Items of fewer words are one
shorter window and are looked up whole.

Cases: a null text has no words; an item or document without words is never hit. Repeated
rows each get the same result, and repeated or null item ids count as one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import ascii_lower, text_or_empty

# Words of a window that counts as contaminated.
WINDOW = 10
# Words in a hashed gram; a window holds WINDOW - GRAM + 1 grams.
GRAM = 5

# Fixed value: runs of these characters are words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _grams(words: Column, size: int) -> Column:
    """Hash of every gram of ``size`` words, in order."""
    last = F.size(words) - size
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, window: int) -> Column:
    """The distinct smallest hashes of all windows of consecutive grams."""
    last = F.size(grams) - window
    least = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(grams, i + j) for j in range(window)])
    )
    return F.when(last >= 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _windows(starts: Column, length: int) -> Column:
    """``start, window`` of the runs of ``words`` that begin at the starts."""
    return F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s + 1, F.lit(length)), " ").alias("window"))
    )


def _stored_words(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows with ``words`` and the hashes of their grams, each computed once."""
    named = rows.select(*keep, "words")
    return named.select(*keep, "words", _grams(F.col("words"), GRAM).alias("grams"))


def item_windows(items: DataFrame, key: str = "item_id", column: str = "text") -> DataFrame:
    """Every window of every item: ``item_id, length, window`` with the words joined by spaces.

    Words hold no spaces, so equal strings are equal windows.
    """
    rows = items.select(F.col(f"`{key}`").alias("item_id"), words_of(text_or_empty(column)).alias("words"))
    rows = rows.where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i, length), " "))
    return rows.select("item_id", length.alias("length"), F.explode(windows).alias("window")).distinct()


def item_fingerprints(items: DataFrame, column: str = "text") -> DataFrame:
    """Distinct winnowed hashes of the items of at least ``WINDOW`` words."""
    rows = items.select(words_of(text_or_empty(column)).alias("words")).where(F.size("words") >= WINDOW)
    grams = _stored_words(rows)
    return grams.select(F.explode(_winnowed(F.col("grams"), WINDOW - GRAM + 1)).alias("print")).distinct()


def _keyed(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Documents with a key that tells different texts under one id apart."""
    text = text_or_empty(column)
    return docs.select(F.col(f"`{key}`").alias("k_id"), F.xxhash64(text).alias("k_text"), text.alias("text"))


def _same(left: str, right: str) -> Column:
    """Both aliases stand for the same document."""
    return F.col(f"{left}.k_text").eqNullSafe(F.col(f"{right}.k_text")) & F.col(f"{left}.k_id").eqNullSafe(F.col(f"{right}.k_id"))


def find_hits(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """Document windows that occur in an item: ``k_id, k_text, start, length, item_id``.

    ``start`` counts words from 0. Only hashes are shuffled or looked up until a document is
    known to share one; its text is then read again for the windows around the shared grams.
    """
    texts = _keyed(docs, key, column)
    windows = item_windows(items, item_key)
    tokens = texts.select("k_id", "k_text", words_of(F.col("text")).alias("words"))

    # Long items: shared fingerprints, then the windows that hold a shared gram.
    long_docs = _stored_words(tokens.where(F.size("words") >= WINDOW), "k_id", "k_text")
    prints = long_docs.select("k_id", "k_text", F.explode(_winnowed(F.col("grams"), WINDOW - GRAM + 1)).alias("print"))
    shared = (
        prints.join(item_fingerprints(items), "print")
        .groupBy("k_id", "k_text")
        .agg(F.collect_set("print").alias("prints"))
    )
    # Texts travel to the shared hashes; their words and grams are made again behind the join.
    again = texts.alias("d").join(shared.alias("s"), _same("d", "s")).select(
        "d.k_id", "d.k_text", "s.prints", words_of(F.col("d.text")).alias("words")
    )
    again = _stored_words(again, "k_id", "k_text", "prints")
    at = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains(F.col("prints"), F.get("grams", i)))
    reach = F.flatten(
        F.transform(
            at,
            lambda p: F.sequence(
                F.greatest(p - (WINDOW - GRAM), F.lit(0)), F.least(p, F.size("words") - WINDOW)
            ),
        )
    )
    candidates = again.select(
        "k_id",
        "k_text",
        F.explode(_windows(F.array_distinct(reach), WINDOW)).alias("c"),
    )
    long_hits = candidates.join(
        windows.where(F.col("length") == WINDOW), F.col("c.window") == F.col("window")
    ).select("k_id", "k_text", F.col("c.start").alias("start"), "length", "item_id")

    # Short items: every run of as many words as some short item has.
    short = windows.where(F.col("length") < WINDOW)
    lengths = sorted(row["length"] for row in short.select("length").distinct().collect())
    hits = long_hits
    for n in lengths:
        starts = F.sequence(F.lit(0), F.size("words") - n)
        runs = tokens.where(F.size("words") >= n).select("k_id", "k_text", F.explode(_windows(starts, n)).alias("c"))
        found = runs.join(short.where(F.col("length") == n), F.col("c.window") == F.col("window"))
        hits = hits.unionByName(found.select("k_id", "k_text", F.col("c.start").alias("start"), "length", "item_id"))
    return hits


def _covered(spans: Column) -> Column:
    """How many words the sorted spans cover together."""
    empty = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        fresh = end - F.greatest(state["upto"], span["start"])
        return F.struct(
            F.greatest(state["upto"], end).alias("upto"), (state["n"] + F.greatest(fresh, F.lit(0))).alias("n")
        )

    return F.aggregate(spans, empty, add, lambda s: s["n"])


RESULTS = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """All columns of ``docs`` and ``n_words, n_hit, n_items, items, contaminated``.

    ``items`` are the ids of the items with a window in the document, as strings, sorted.
    Result columns replace columns of the same name.
    """
    hits = find_hits(docs, items, key, column, item_key)
    # Windows are counted once however many items hold them, before rows meet by document.
    places = hits.select("k_id", "k_text", "start", "length").distinct()
    covered = places.groupBy("k_id", "k_text").agg(
        _covered(F.array_sort(F.collect_list(F.struct("start", "length")))).alias("n_hit")
    )
    named = hits.groupBy("k_id", "k_text").agg(
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items")
    )
    facts = covered.alias("c").join(named.alias("n"), _same("c", "n")).select("c.*", "n.items")
    text = text_or_empty(column)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS])
    rows = docs.select(
        row.alias("row"),
        F.col(f"`{key}`").alias("k_id"),
        F.xxhash64(text).alias("k_text"),
        F.size(words_of(text)).cast("bigint").alias("n_words"),
    )
    joined = rows.alias("r").join(facts.alias("f"), _same("r", "f"), "left")
    n_hit = F.coalesce(F.col("f.n_hit"), F.lit(0).cast("bigint"))
    found = F.coalesce(F.col("f.items"), F.array().cast("array<string>"))
    return joined.select(
        "r.row.*",
        "r.n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("bigint").alias("n_items"),
        found.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
