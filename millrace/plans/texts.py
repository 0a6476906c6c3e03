"""Word counts, distinct-count sketches and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import search_index, sketches
from millrace.operators.aggregates import word_count
from millrace.operators.search import catch_all, search_count, tokenize_col
from millrace.session import scratch_dir
from millrace.sinks.versions import Versions
from millrace.sources.catalog import table
from millrace.sources.files import read_lines


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    return word_count(table(spark, folder, "documents"), "text")


def line_words(spark: SparkSession, folder: str) -> DataFrame:
    """Word count over plain text files."""
    path = scratch_dir(spark, "lines")
    table(spark, folder, "conversations").select("text").write.text(path)
    return word_count(read_lines(spark, path))


def _beside_exact(estimated: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Exact counts and whether the estimate is within five percent of them."""
    both = (
        estimated.unionByName(exact, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max("exact").alias("exact"), F.max("estimate").alias("estimate"))
    )
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.lit(0.05) * F.col("exact")
    return both.select(*keys, "exact", close.alias("close"))


def sketch_global(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    exact = lines.agg(F.count_distinct("l_orderkey").alias("exact"))
    return _beside_exact(sketches.approx_distinct(lines, "l_orderkey"), exact, [])


def sketch_by_key(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return _beside_exact(sketches.estimates(sketches.sketch_by(events, ["event_type"], "user_id")), exact, ["event_type"])


def sketch_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches made per partition, stored, and merged without the raw data."""
    lines = table(spark, folder, "lineitem")
    stored = sketches.partition_sketches(lines, ["l_returnflag"], "l_orderkey", scratch_dir(spark, "sketches"))
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("exact"))
    merged = sketches.estimates(sketches.merge_sketches(stored, ["l_returnflag"]))
    return _beside_exact(merged, exact, ["l_returnflag"])


def search_term(spark: SparkSession, folder: str) -> DataFrame:
    return search_count(table(spark, folder, "documents"), ["text", "lang", "source"], "the")


def analysed_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Number of terms in the catch-all field of every page."""
    fields = catch_all(table(spark, folder, "pages"), ["url", "html"])
    return tokenize_col(fields, "_text_").select("page_id", F.size("tokens").alias("terms"))


SEARCHED = ["text", "lang", "source"]


# The indexes that this application has built, by the folder of their documents.
_INDEXES: dict[tuple[str, str], str] = {}


def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index of all documents, added in two segments; queries of one application share it."""
    place = (spark.sparkContext.applicationId, folder)
    if place in _INDEXES and Versions(spark, _INDEXES[place]).current()[0] == 2:
        return search_index.open_index(spark, _INDEXES[place])
    path = _INDEXES[place] = scratch_dir(spark, "index")
    docs = table(spark, folder, "documents")
    english = F.col("lang").eqNullSafe("en")
    for part in (docs.where(english), docs.where(~english)):
        search_index.add_documents(part, path, "doc_id", SEARCHED)
    return search_index.open_index(spark, path)


def search_index_count(spark: SparkSession, folder: str) -> DataFrame:
    return search_index.index_count(document_index(spark, folder), "the")


def search_index_all(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold both terms."""
    return search_index.with_all(document_index(spark, folder), "the and")


def search_index_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold two terms in a row."""
    return search_index.with_phrase(document_index(spark, folder), "of the")


def search_index_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every indexed term with its documents and occurrences, after the segments have been merged."""
    path = scratch_dir(spark, "index")
    docs = table(spark, folder, "documents")
    search_index.add_documents(docs.where("n_chars < 2000"), path, "doc_id", SEARCHED)
    search_index.add_documents(docs.where("n_chars >= 2000 OR n_chars IS NULL"), path, "doc_id", SEARCHED)
    search_index.merge_segments(spark, path)
    return search_index.dictionary(search_index.open_index(spark, path))


QUERIES = {
    "word_count": document_words,
    "line_word_count": line_words,
    "sketch_global": sketch_global,
    "sketch_by_key": sketch_by_key,
    "sketch_merged": sketch_merged,
    "search_count": search_term,
    "analysed_terms": analysed_lengths,
    "search_index_count": search_index_count,
    "search_index_all": search_index_all,
    "search_index_phrase": search_index_phrase,
    "search_index_terms": search_index_terms,
}

TERM_LISTS = r"""
        WITH t AS (
            SELECT doc_id AS doc, regexp_extract_all(lower(concat_ws(' ', text, lang, source)), '[\p{L}\p{M}\p{N}]+') AS w
            FROM documents)"""

ORACLES = {
    "word_count": r"""
        SELECT word, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM documents) GROUP BY word""",
    "line_word_count": r"""
        SELECT word, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM conversations) GROUP BY word""",
    "sketch_global": "SELECT count(DISTINCT l_orderkey) AS exact, true AS close FROM lineitem",
    "sketch_by_key": """
        SELECT event_type, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY event_type""",
    "sketch_merged": """
        SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag""",
    "search_count": r"""
        SELECT count(*) AS num_found FROM documents
        WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', text, lang, source)), '[\p{L}\p{M}\p{N}]+'), 'the')""",
    "analysed_terms": r"""
        SELECT page_id, CAST(len(regexp_extract_all(lower(concat_ws(' ', url, html)), '[\p{L}\p{M}\p{N}]+')) AS INTEGER) AS terms
        FROM pages""",
    "search_index_count": TERM_LISTS + """
        SELECT count(*) AS num_found FROM t WHERE list_contains(w, 'the')""",
    "search_index_all": TERM_LISTS + """
        SELECT doc, CAST(len(list_filter(w, lambda x: x = 'the' OR x = 'and')) AS BIGINT) AS hits
        FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'and')""",
    "search_index_phrase": TERM_LISTS + """
        SELECT doc, hits FROM (
            SELECT doc, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS BIGINT) AS hits FROM t)
        WHERE hits > 0""",
    "search_index_terms": TERM_LISTS + """
        SELECT term, count(DISTINCT doc) AS docs, count(*) AS occurrences
        FROM (SELECT doc, unnest(w) AS term FROM t) GROUP BY term""",
}
