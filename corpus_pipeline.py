"""A corpus as training data: toxic texts go, one of each group of near copies stays, benchmark
passages and personal data go, and what is left becomes token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again
before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, decontaminate, learning, ngram_join, pii, toxicity
from millrace.llm.common import prepare_workers
from millrace.llm.queries import TOXIC_FOLDS, TOXIC_FROM, TOXIC_HELD_OUT
from millrace.session import cut_lineage
from millrace.sources.catalog import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    prepare_workers(spark)
    labels = table(spark, sf_dir, "labels")
    rows = learning.labelled(docs.select("doc_id", "text"), labels, "toxic", "doc_id", TOXIC_FOLDS, TOXIC_HELD_OUT)
    scored = toxicity.score(docs, toxicity.fit(rows))
    return scored.where(F.col("toxicity_score") < TOXIC_FROM).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and telling terms are replaced in the texts."""
    clean = pii.sanitise(docs)
    counted = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.select(*[counted.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids, with the digests of the ids and of the decoded bytes."""
    prepare_workers(spark)
    return bpe.encode(docs).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("byte_bpe", to_tokens),
]

# Learned scores and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
