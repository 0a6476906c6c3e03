"""Whole-term search over a catch-all text field."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from millrace.functions.text import LETTERS_DIGITS, terms

# Fixed value: the name of the catch-all field.
CATCH_ALL = "_text_"


def catch_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Copy the named fields, multi-valued ones included, into one text field."""
    fields: list[Column] = []
    for name in columns:
        kind = df.schema[name].dataType
        many = isinstance(kind, ArrayType)
        fields.append(F.col(name).cast("array<string>" if many else "string"))
    return df.withColumn(CATCH_ALL, F.concat_ws(" ", *fields))


def tokenize_col(df: DataFrame, column: str, name: str = "tokens") -> DataFrame:
    """Add the analysed form of a text column: lower-case terms in order."""
    return df.withColumn(name, terms(F.col(column)))


def matches(text: Column, term: str) -> Column:
    """Whether the analysed text holds the term as a whole.

    Equal to looking the term up among the tokens, but stops at the first hit and
    builds no token list: a token is a run of term characters with none beside it.
    """
    if not term or any(unicodedata.category(sign)[0] not in "LMN" for sign in term):
        raise ValueError(f"not a single search term: {term!r}")
    return F.rlike(F.lower(text), F.lit(f"(?<![{LETTERS_DIGITS}]){term.lower()}(?![{LETTERS_DIGITS}])"))


def search_count(df: DataFrame, columns: list[str], term: str, name: str = "num_found") -> DataFrame:
    """How many rows match a term in any of the fields."""
    found = catch_all(df.select(*columns), columns).where(matches(F.col(CATCH_ALL), term))
    return found.agg(F.count(F.lit(1)).alias(name))
