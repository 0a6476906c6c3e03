"""Statistics of whole texts: the inputs of the quality classifier and the quality rules.

Cases: a null text is empty and all its statistics are 0. Words are runs of characters other than
ASCII white space. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import text_or_empty, with_results

# The symbols that are counted, and the words in a repeated window.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Counts come first; the shares and means after them are what rules and models look at.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "symbols_per_word",
    "symbol_ends_share",
    "pipe_share",
    "exclamation_share",
    "dup_line_share",
    "repeat_word_share",
    "mean_word_chars",
    "spread_word_chars",
    "distinct_share",
    "top_word_share",
    "same_next_share",
    "upper_share",
    "digit_share",
    "mark_share",
    "non_ascii_share",
    "words_per_line",
    "short_line_share",
    "capital_word_share",
    "log_words",
]
NAMES = COUNTS + SHARES

# Fixed odd numbers that mix the words of a window.
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1) | 1 for j in range(WINDOW)], dtype=np.uint64)


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows that occur twice or more, by the words' numbers in the text."""
    windows = len(codes) - WINDOW + 1
    if windows < 2:
        return 0
    wide = codes.astype(np.uint64) + np.uint64(1)
    mixed = np.zeros(windows, dtype=np.uint64)
    for j in range(WINDOW):
        mixed += (wide[j : j + windows] * wide[j : j + windows] + wide[j : j + windows]) * _MIX[j]
    if len(np.unique(mixed)) == windows:
        return 0
    # Some may be equal: number the windows exactly, doubling their length.
    ranks, length = codes.astype(np.int64), 1
    while length < WINDOW:
        pairs = ranks[: len(ranks) - length] * (int(ranks.max()) + 1) + ranks[length:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        length *= 2
    again = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(len(codes) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_statistics(text: str) -> list[float]:
    """The values of ``NAMES`` for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    counts = np.bincount(codes)
    byte = np.frombuffer(raw, dtype=np.uint8)
    seen = np.bincount(byte, minlength=256)
    leads = seen[:128].sum() + seen[192:].sum()
    spaces = seen[32] + seen[9:14].sum()
    word_chars = int(leads - spaces)
    symbols = int(sum(seen[ord(c)] for c in SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    line_counts = Counter(lines)
    dup_lines = len(lines) - len(line_counts)
    repeats = repeated_words(codes)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = Counter(w[-1:] for w in words)
    upper = int(seen[65:91].sum())
    lower = int(seen[97:123].sum())
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    line_words = [len(line.split()) for line in lines]
    return [
        float(n),
        float(word_chars),
        float(symbols),
        float(dup_lines),
        float(repeats),
        symbols / n,
        sum(ends[c.encode()] for c in SYMBOLS) / n,
        seen[ord("|")] / n,
        seen[ord("!")] / n,
        dup_lines / len(lines),
        repeats / n,
        word_chars / n,
        float(lengths.std()),
        len(counts) / n,
        float(counts.max()) / n,
        float((codes[1:] == codes[:-1]).sum()) / n,
        upper / max(1, upper + lower),
        int(seen[48:58].sum()) / max(1, word_chars),
        marks / max(1, word_chars),
        int(seen[192:].sum()) / max(1, word_chars),
        n / len(lines),
        sum(k <= 3 for k in line_words) / len(lines),
        sum(w[:1].isupper() for w in numbers) / len(numbers),
        math.log1p(n),
    ]


SCHEMA = ", ".join(f"{name} bigint" for name in COUNTS) + ", " + ", ".join(f"{name} double" for name in SHARES)


def with_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns of ``docs`` and the statistics, which replace columns of the same name."""

    @F.pandas_udf(SCHEMA)
    def computed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = pd.DataFrame([text_statistics(text) for text in texts], columns=NAMES)
            yield values.astype({name: "int64" for name in COUNTS})

    return with_results(docs, computed(text_or_empty(column)), NAMES)
