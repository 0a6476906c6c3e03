"""Tokenising and escaping expressions. Terms are runs of letters (and digits) of any script, lower-cased."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Letters with their combining marks, and digits of every script.
LETTERS = r"\p{L}\p{M}"
LETTERS_DIGITS = r"\p{L}\p{M}\p{N}"


def words(text: Column) -> Column:
    """Lower-case runs of letters, the word-count tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{LETTERS}]+"), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, the search terms of an analysed field."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{LETTERS_DIGITS}]+"), F.lit(0))


def literal_pattern(separator: str) -> str:
    """A regular expression that matches ``separator`` itself."""
    return "".join(c if c.isalnum() else "\\" + c for c in separator)


def escaped(cell: Column, sep: str) -> Column:
    """A text without the separator or line ends: they become ``\\s``, ``\\n`` and ``\\r``, a backslash two."""
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), (sep, "\\s")):
        cell = F.replace(cell, F.lit(plain), F.lit(code))
    return cell


def unescaped(cell: Column, sep: str) -> Column:
    """The text before :func:`escaped`. Between escaped backslashes every code stands for itself."""

    def plain(part: Column) -> Column:
        for code, sign in (("\\n", "\n"), ("\\r", "\r"), ("\\s", sep)):
            part = F.replace(part, F.lit(code), F.lit(sign))
        return part

    parts = F.transform(F.split(cell, r"\\\\", -1), plain)
    return F.when(F.contains(cell, F.lit("\\")), F.array_join(parts, "\\")).otherwise(cell)
