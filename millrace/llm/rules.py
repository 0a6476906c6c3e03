"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering.

Each rule is grown on part of the labelled texts by adding the threshold with the most
information gain until it covers bad texts only, and pruned on the rest by dropping
last conditions that do not pay. Texts that a rule covers leave the sample and the next rule is
grown, until no rule is right often enough. The list is a Spark conditional expression over
the statistics: the first rule that holds rejects the text.

Cases: a null or empty text has no words. Without labels of both classes the list is empty and
keeps everything. Result columns replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import learning, statistics
from millrace.session import cut_lineage

# The most rules and conditions of a rule, and candidate thresholds of a statistic.
MAX_RULES = 24
MAX_CONDITIONS = 4
THRESHOLDS = 48
# A rule must be right on this share of the texts it rejects, and reject so many.
PRECISION = 0.9
MIN_COVER = 4
# Base rule: fewer words, or a larger share of words in repeated windows, fail.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

Condition = tuple[str, str, float]


def holds(rule: list[Condition], table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), dtype=bool)
    for name, sign, bound in rule:
        out &= table[name] > bound if sign == ">" else table[name] <= bound
    return out


def _candidates(table: dict[str, np.ndarray], covered: np.ndarray) -> list[Condition]:
    found: list[Condition] = []
    for name, values in table.items():
        here = values[covered]
        if len(here) == 0:
            continue
        distinct = np.unique(here)
        if len(distinct) < 2:
            continue
        middles = (distinct[1:] + distinct[:-1]) / 2
        picks = np.unique(np.linspace(0, len(middles) - 1, THRESHOLDS).astype(int))
        # Quantiles as well, so that crowded ranges get their thresholds.
        some = np.concatenate([middles[picks], np.quantile(here, np.linspace(0.02, 0.98, THRESHOLDS))])
        found += [(name, sign, float(f"{bound:.6g}")) for bound in np.unique(some) for sign in (">", "<=")]
    return found


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    covered = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int(bad[covered].sum()), int((~bad[covered]).sum())
        if not p or not n:
            break
        before = np.log2(p / (p + n))
        best, best_gain = None, 1e-9
        for name, sign, bound in _candidates(table, covered):
            values = table[name]
            now = covered & (values > bound if sign == ">" else values <= bound)
            p1 = int(bad[now].sum())
            if p1 < MIN_COVER:
                continue
            gain = p1 * (np.log2(p1 / int(now.sum())) - before)
            if gain > best_gain:
                best, best_gain = (name, sign, bound), gain
        if best is None:
            break
        rule.append(best)
        covered &= holds([best], table)
    return rule


def _worth(rule: list[Condition], table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = holds(rule, table)
    p, n = int(bad[covered].sum()), int((~bad[covered]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[list[Condition]]:
    """Rules for bad texts, in the order in which they apply."""
    rules: list[list[Condition]] = []
    if len(bad) == 0 or bad.all() or not bad.any():
        return rules
    left = np.ones(len(bad), dtype=bool)
    random = np.random.default_rng(seed)
    grows = random.random(len(bad)) < 2 / 3
    while len(rules) < MAX_RULES and bad[left].any():
        def part(mask):
            return {name: values[mask] for name, values in table.items()}, bad[mask]

        rule = _grow(*part(left & grows))
        pruning = part(left & ~grows)
        while len(rule) > 1 and _worth(rule[:-1], *pruning) >= _worth(rule, *pruning):
            rule = rule[:-1]
        if not rule:
            break
        covered = left & holds(rule, table)
        right = int(bad[covered].sum())
        if right < MIN_COVER or right < PRECISION * int(covered.sum()):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds, from 1, or 0 if none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, bound in rule:
            test = test & (F.col(name) > bound if sign == ">" else F.col(name) <= bound)
        out = F.when(test, number) if out is None else out.when(test, number)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(rows: DataFrame, key: str = "doc_id", at_most: int = learning.SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules from rows of statistics with ``label`` (1: good); about ``at_most`` rows are used."""
    few = cut_lineage(learning.bounded(rows.select(key, *statistics.SHARES, "label"), key, at_most))
    table = few.orderBy(key, *statistics.SHARES).toPandas()
    return learn({name: table[name].to_numpy(dtype=float) for name in statistics.SHARES}, table["label"].to_numpy() == 0)


def judge(rows: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """All columns of ``rows``, which hold the statistics, and ``rule, base_failed, kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    names = {"rule", "base_failed", "kept"}
    plain = rows.drop(*[c for c in rows.columns if c.lower() in names])
    judged = plain.withColumn("rule", expression(rules)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
