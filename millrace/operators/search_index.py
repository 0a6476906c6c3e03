"""An inverted index over text fields, stored as segments of sorted postings.

A posting is ``(term, doc, positions)``. Tasks make the postings of their documents, so texts are
analysed once and only postings travel. A segment is written in one shuffle: postings are cut into
files by ranges of (term, doc) and sorted by them, so a term is one stretch of one file, or of a few
files if a large share of all documents holds it. Queries name their terms, the condition reaches
the Parquet statistics, and no text is read. New documents become one more segment; ``merge_segments`` makes
one of all.

A document is known by its key, which has to be unique; positions of rows under one key are put together. Terms are lower-case runs of letters
and digits, positions count them from 0 over all fields together. A null field has no terms.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from millrace.functions.text import terms
from millrace.operators.search import CATCH_ALL, catch_all
from millrace.session import scratch_dir
from millrace.sinks.versions import Versions


def _of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``term, doc, positions`` of the rows ``doc, terms``."""
    docs, lists = batch.columns
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = lists.flatten().dictionary_encode()
    entry = row * max(1, len(words.dictionary)) + words.indices.to_numpy()
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else order
    offsets = pa.array(np.append(first, len(entry)).astype(np.int32))
    positions = pa.ListArray.from_arrays(offsets, pa.array(at[order].astype(np.int32)))
    held = order[first]
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(words.indices.take(pa.array(held))), docs.take(pa.array(row[held])), positions], ["term", "doc", "positions"]
    )


def row_postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``term, doc, positions`` of every row, by itself."""
    texts = catch_all(docs.select(F.col(key).alias("doc"), *columns), columns)
    cut = texts.select("doc", terms(F.col(CATCH_ALL)).alias("terms"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _of_batch(batch)

    fields = [StructField("term", StringType()), cut.schema["doc"], StructField("positions", ArrayType(IntegerType()))]
    return cut.mapInArrow(found, StructType(fields))


def _keys_repeat(docs: DataFrame, key: str) -> bool:
    return not docs.groupBy(F.col(key)).count().where("count > 1").isEmpty()


def _placed(found: DataFrame, repeated: bool) -> DataFrame:
    """Postings cut and sorted by term and document; ``repeated`` tells that several rows can be under one key."""
    ranged = found.repartitionByRange("term", "doc")
    if repeated:
        # The grouping needs no further shuffle: a range of (term, doc) holds its groups whole.
        ranged = ranged.groupBy("term", "doc").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return ranged.sortWithinPartitions("term", "doc")


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``term, doc, positions`` of all documents, cut and sorted by term and document."""
    return _placed(row_postings(docs, key, columns), _keys_repeat(docs, key))


def add_documents(docs: DataFrame, index: str, key: str, columns: list[str]) -> int:
    """Add documents as a segment of a new or existing index; returns the new version."""
    spark = docs.sparkSession
    versions = Versions(spark, index)
    number, segments = versions.current()
    path = f"{index.rstrip('/')}/segment-{uuid.uuid4().hex}"
    # Ranges are chosen in a pass of their own, so postings are stored before they are dealt.
    staged = scratch_dir(spark, "postings")
    row_postings(docs, key, columns).write.parquet(staged)
    _placed(spark.read.parquet(staged), _keys_repeat(docs, key)).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return versions.publish(number, [*segments, path])


def open_index(spark: SparkSession, index: str) -> DataFrame:
    """The postings of all segments."""
    _, segments = Versions(spark, index).current()
    if not segments:
        raise FileNotFoundError(f"no index in {index}")
    return spark.read.parquet(*segments)


def merge_segments(spark: SparkSession, index: str) -> int:
    """Make one segment of all; returns the new version."""
    versions = Versions(spark, index)
    number, _ = versions.current()
    path = f"{index.rstrip('/')}/segment-{uuid.uuid4().hex}"
    whole = open_index(spark, index).repartitionByRange("term", "doc").sortWithinPartitions("term", "doc")
    whole.write.parquet(path)
    return versions.publish(number, [path])


def analysed(text: str) -> list[str]:
    """The terms of a query text, as documents are analysed."""
    found, run = [], ""
    for sign in text.lower() + " ":
        if unicodedata.category(sign)[0] in "LMN":
            run += sign
        elif run:
            found.append(run)
            run = ""
    return found


def _of(index: DataFrame, wanted: list[str]) -> DataFrame:
    if not wanted:
        raise ValueError("a query needs a term")
    condition = F.col("term") == wanted[0] if len(wanted) == 1 else F.col("term").isin(wanted)
    return index.where(condition)


def index_count(index: DataFrame, term: str, name: str = "num_found") -> DataFrame:
    """How many documents hold the term."""
    return _of(index, _one(term)).agg(F.count(F.lit(1)).alias(name))


def _one(term: str) -> list[str]:
    found = analysed(term)
    if len(found) != 1:
        raise ValueError(f"not a single search term: {term!r}")
    return found


def with_all(index: DataFrame, query: str) -> DataFrame:
    """``doc, hits``: documents that hold every term of the query, and how often they hold any."""
    wanted = list(dict.fromkeys(analysed(query)))
    held = _of(index, wanted).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("positions")).alias("hits"))
    return held.where(F.col("n") == len(wanted)).select("doc", "hits")


def _moved_back(by: int) -> Column:
    return F.transform("positions", lambda at: at - by)


def with_phrase(index: DataFrame, query: str) -> DataFrame:
    """``doc, hits``: documents with the terms of the query in a row, and how often."""
    wanted = analysed(query)
    _of(index, wanted)
    offsets: dict[str, list[int]] = {}
    for offset, term in enumerate(wanted):
        offsets.setdefault(term, []).append(offset)
    begins: Column | None = None
    for term, places in offsets.items():
        here = F.flatten(F.array(*[_moved_back(place) for place in places]))
        begins = F.when(F.col("term") == term, here) if begins is None else begins.when(F.col("term") == term, here)
    starts = _of(index, list(offsets)).select("doc", F.explode(begins).alias("start"))
    whole = starts.groupBy("doc", "start").count().where(F.col("count") == len(wanted))
    return whole.groupBy("doc").agg(F.count(F.lit(1)).alias("hits"))


def dictionary(index: DataFrame) -> DataFrame:
    """``term, docs, occurrences`` of every indexed term."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("positions")).alias("occurrences"))
