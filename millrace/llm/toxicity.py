"""Toxicity scores from misspelled lexicon terms and the words around them.

The lexicon is learned from labelled texts: words and stems (beginnings of words) that occur in
far more toxic than clean texts. Its trie is intersected with a Levenshtein automaton, so every
term within the allowed edits is found in one walk over a word; the states of the product are built when
they are first reached. Words joined by hyphens, apostrophes or underscores are looked up whole and in
parts, and with digits and signs read as the letters that they are written for. Each hit is weighed by how well its term tells the classes apart, a misspelling by
that and by its edits, and split into quoted and unquoted by its context window: between quotation marks
of any kind, after a reporting verb and a colon, or on a line that begins with ``>``. A logistic model over
these sums gives the score; quoted hits count for nothing unless the labels show that they do.

Cases: a null or empty text has no hits and gets the score of such texts. With no labels, or
labels of one class only, the lexicon is empty and all scores are the same. Texts are read
whole. Result columns replace columns of the same name.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import learning
from millrace.llm.common import text_or_empty, with_results
from millrace.session import cut_lineage

NAMES = ["toxicity_hits", "toxicity_quoted", "toxicity_score"]

# Texts that must hold a term.
MIN_TEXTS = 5
# Chance of any one term in the lexicon by accident, over all candidate terms.
SIGNIFICANCE = 0.05
# Lengths of the stems that are tried.
STEMS = (4, 5, 6)
# Words of at least so many letters are found with one and with two edits.
ONE_EDIT, TWO_EDITS = 5, 10
# Words on either side of a hit that form its context.
CONTEXT = 8
# Distinct words that a worker remembers.
CACHE_WORDS = 200_000

# Signs that stand for letters may begin a word or stand in it; hyphens and apostrophes join words.
WORD = re.compile(r"[@$!]*\w+(?:[@$*!'’-]+\w+)*")
JOINTS = re.compile(r"[-'’_]+")
# Digits and signs that are written for letters.
SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
QUOTES = re.compile(r"[\"“”„«»‘]|(?<!\w)'|['’](?!\w)")
# Verbs that announce another's words, if a colon follows them.
REPORTS = re.compile(r"\b(?:said|says|wrote|writes|quoted|quotes|dit|écrit|sagte|schrieb|dijo|escribió)\b[^.!?]{0,40}:[^.!?]*$")
QUOTED_LINE = re.compile(r"\s*>")
STEM = "*"
Hit = tuple[int, int, int, bool, str]

# What an edit leaves of a term's weight before any are seen, and the texts that this guess counts for.
KEEPS, GUESSED = 0.7, 4.0
# Texts that the weight expected of a misspelling counts for beside those that hold it.
EXPECTED = 2.0


def allowed_edits(term: str) -> int:
    letters = len(term.rstrip(STEM))
    if term.endswith(STEM):
        return 0 if letters < TWO_EDITS else 1
    return 2 if letters >= TWO_EDITS else 1 if letters >= ONE_EDIT else 0


class FuzzyTrie:
    """The product of a trie of terms and a Levenshtein automaton, made deterministic on demand."""

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.reach = [0]
        for number, term in enumerate(terms):
            node, edits = 0, allowed_edits(term)
            self.reach[0] = max(self.reach[0], edits)
            for letter in term.rstrip(STEM):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], edits)
            (self.stem if term.endswith(STEM) else self.word)[node] = number
        self.allowed = [allowed_edits(term) for term in terms]
        self.letters = {letter for node in self.children for letter in node}
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._closed({0: 0}), None)

    def _closed(self, reached: dict[int, int]) -> dict[int, int]:
        """Add the nodes reached by leaving letters out, with the fewest edits of each."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            edits = reached[node] + 1
            for child in self.children[node].values():
                if edits <= self.reach[child] and edits < reached.get(child, 9):
                    reached[child] = edits
                    todo.append(child)
        return reached

    def _state(self, reached: dict[int, int], stem: tuple[int, int] | None) -> int:
        for node, number in self.stem.items():
            edits = reached.get(node, 9)
            if edits <= self.allowed[number] and (stem is None or edits < stem[0]):
                stem = (edits, number)
        key = (frozenset(reached.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append((reached, stem, self._accepts(reached, stem)))
            self.steps.append({})
        return self.states[key]

    def _accepts(self, reached: dict[int, int], stem: tuple[int, int] | None) -> tuple[int, int] | None:
        found = [(edits, self.word[node]) for node, edits in reached.items() if node in self.word]
        found = [hit for hit in found if hit[0] <= self.allowed[hit[1]]]
        return min(found + ([stem] if stem else []), default=None)

    def _step(self, state: int, letter: str) -> int:
        reached, stem, _ = self.sets[state]
        after: dict[int, int] = {}
        for node, edits in reached.items():
            if edits + 1 <= self.reach[node]:
                after[node] = min(after.get(node, 9), edits + 1)
            for sign, child in self.children[node].items():
                cost = edits if sign == letter else edits + 1
                if cost <= self.reach[child]:
                    after[child] = min(after.get(child, 9), cost)
        return self._state(self._closed(after), stem)

    def find(self, word: str) -> tuple[int, int] | None:
        """Edits and number of the nearest term of a word, or None."""
        if not self.letters:
            return None
        state = self.start
        for letter in word:
            known = letter if letter in self.letters else ""
            following = self.steps[state].get(known)
            if following is None:
                following = self.steps[state][known] = self._step(state, known)
            state = following
            reached, stem, _ = self.sets[state]
            if not reached:
                return stem
        return self.sets[state][2]


class Finder:
    """Hits of a lexicon in texts, with remembered words."""

    def __init__(self, terms: tuple[str, ...]):
        self.trie = FuzzyTrie(terms)
        self.known: dict[str, tuple[int, int] | None] = {}

    def nearest(self, word: str) -> tuple[int, int] | None:
        """Edits and number of the nearest term of a word, its parts, or these with swapped signs read as letters.

        A form with swapped signs is a misspelling, so it has one edit at least.
        """
        parts = [part for part in JOINTS.split(word) if part]
        forms = dict.fromkeys([word, *parts])
        found = [hit for form in forms if (hit := self.trie.find(form))]
        swapped = dict.fromkeys(form.translate(SWAPS) for form in forms if not form.isalpha() and not form.isdigit())
        found += [(max(1, hit[0]), hit[1]) for form in swapped if form not in forms and (hit := self.trie.find(form))]
        return min(found, default=None)

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, bool]], int]:
        """``place, edits, term, quoted, word`` of every hit, and the number of words."""
        low = text.lower()
        words = WORD.findall(low)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = self.nearest(word)
        found = [(i, hit) for i, hit in enumerate(map(self.known.__getitem__, words)) if hit]
        if not found:
            return [], len(words)
        spans = [match.span() for match in WORD.finditer(low)]
        out = []
        for place, (edits, term) in found:
            start, end = spans[place]
            before = low[spans[max(0, place - CONTEXT)][0] : start]
            # Marks right before the first or after the last word of the window belong to it.
            before = (low[max(0, spans[max(0, place - CONTEXT)][0] - 1) : spans[max(0, place - CONTEXT)][0]] + before).rpartition("\n")[2]
            after = low[end : spans[min(len(spans) - 1, place + CONTEXT)][1] + 1].partition("\n")[0]
            quoted = len(QUOTES.findall(before)) % 2 == 1 and bool(QUOTES.search(after))
            quoted = quoted or bool(REPORTS.search(before)) or bool(QUOTED_LINE.match(low, low.rfind("\n", 0, start) + 1))
            out.append((place, edits, term, quoted, words[place]))
        return out, len(words)


@functools.lru_cache(maxsize=4)
def _finder(terms: tuple[str, ...]) -> Finder:
    return Finder(terms)


def _stems(words: Column, letters: int) -> Column:
    """The beginnings of the words that have more letters."""
    longer = F.filter(words, lambda word: F.length(word) > letters)
    return F.transform(longer, lambda word: F.concat(F.substring(word, 1, letters), F.lit(STEM)))


def learn_lexicon(sample: DataFrame, column: str = "text") -> tuple[str, ...]:
    """Terms of a labelled sample, the strongest first; a stem ends in ``*``.

    Candidates are scored by the likelihood ratio of their texts in both classes, and kept if that
    is significant over all candidates and the term is at least four times as common in toxic texts.
    Words are never left out for a stem, as only they are found with edits. A stem is kept where several
    words need it: if its ratio exceeds that of each word or longer stem that begins with it by
    as much as is significant over the terms found. Copies of one text count once.
    """
    texts = sample.groupBy(F.xxhash64(text_or_empty(column)).alias("same"), "label").agg(
        F.any_value(text_or_empty(column)).alias("text")
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    rows = texts.select("label", words.alias("words"))
    stems = [_stems(F.col("words"), letters) for letters in STEMS]
    terms = F.array_distinct(F.concat("words", *stems))
    totals = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    toxic, clean = totals["toxic"] or 0, totals["clean"] or 0
    if not toxic or not clean:
        return ()
    counts = (
        rows.select("label", F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    )
    counts = cut_lineage(counts.where(F.col("a") >= 2))
    candidates = max(1, counts.count())
    rate = (F.col("a") + F.col("b")) / (toxic + clean)

    def part(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = (
        part(F.col("a"), toxic * rate)
        + part(F.col("b"), clean * rate)
        + part(toxic - F.col("a"), toxic * (1 - rate))
        + part(clean - F.col("b"), clean * (1 - rate))
    )
    least = 2 * math.log(candidates / SIGNIFICANCE)
    strong = counts.where((F.col("a") >= MIN_TEXTS) & (F.col("a") * clean > 4 * F.col("b") * toxic))
    best = strong.select("term", ratio.alias("ratio")).where(F.col("ratio") >= least)
    letters = F.length(F.rtrim(F.lit(STEM), "term"))
    ordered = best.orderBy(F.col("ratio").desc(), letters.desc(), "term").collect()
    return chosen_terms([(row["term"], row["ratio"]) for row in ordered], 2 * math.log(max(1, len(ordered)) / SIGNIFICANCE))


def chosen_terms(ordered: list[tuple[str, float]], least: float) -> tuple[str, ...]:
    """The words of ``ordered``, and the stems that say more by ``least`` than any longer term that they begin."""
    longer: dict[str, float] = {}
    for term, ratio in ordered:
        bare = term.rstrip(STEM)
        for letters in STEMS:
            if len(bare) > letters:
                longer[bare[:letters]] = max(ratio, longer.get(bare[:letters], 0.0))
    kept: list[str] = []
    for term, ratio in ordered:
        if term.endswith(STEM):
            covered = any(term.startswith(other[:-1]) for other in kept if other.endswith(STEM))
            needed = term[:-1] not in longer or ratio >= longer[term[:-1]] + least
            if covered or not needed:
                continue
        kept.append(term)
    return tuple(kept)


HIT = ("place", "edits", "term", "quoted", "word")
FEATURES = ["unquoted", "quoted", "densest", "share"]


def features(hits: list[Hit], words: int, weigh: Callable[[int, int, str], float]) -> list[float]:
    """Sums of hit weights by quotation, the densest context window, and weight per word."""
    open_, quoted, places = 0.0, 0.0, []
    for place, edits, term, inside, word in hits:
        weight = weigh(term, edits, word)
        if inside:
            quoted += weight
        elif weight > 0:
            open_ += weight
            places.append(place)
    densest, first = 0, 0
    for i, place in enumerate(places):
        while place - places[first] > 2 * CONTEXT:
            first += 1
        densest = max(densest, i - first + 1)
    return [math.log1p(open_), math.log1p(quoted), float(min(densest, 8)), open_ / max(words, 20)]


class Weights:
    """Weights of hits: of a term from its exact hits, of a misspelling from its term and from the texts that hold it.

    Nothing else is known of a misspelling not met in the sample than its term and the number of edits.
    It has the term's weight with a discount for so many edits, corrected by
    the misspellings of the term that occur in a single text, as these are most like new ones. Words
    near a term that clean texts hold too lose that weight by their own counts.
    """

    def __init__(self, labels: Iterable[float], hits: Iterable[list[Hit]], terms: int):
        labels = list(labels)
        toxic, clean = max(1.0, sum(labels)), max(1.0, len(labels) - sum(labels))
        # Toxic texts count as much in all as clean ones.
        self.even = toxic / clean
        exact = [[0.0, 0.0] for _ in range(terms)]
        self.seen: dict[tuple[int, int, str], list[float]] = {}
        for label, own in zip(labels, hits, strict=True):
            for term, edits, word in {(h[2], h[1], h[4]) for h in own if h[1]}:
                self.seen.setdefault((term, edits, word), [0.0, 0.0])[int(label)] += 1
            for term in {h[2] for h in own if not h[1]}:
                exact[term][int(label)] += 1
        self.exact = [max(0.0, math.log((b + 0.5) / (toxic + 1)) - math.log((a + 0.5) / (clean + 1))) for a, b in exact]
        once: dict[tuple[int, int], list[float]] = {}
        for (term, edits, _), count in self.seen.items():
            if sum(count) == 1:
                both = once.setdefault((term, edits), [0.0, 0.0])
                both[0], both[1] = both[0] + count[0], both[1] + count[1]
        self.unseen = {}
        for term, weight in enumerate(self.exact):
            for edits in (1, 2):
                clean_once, toxic_once = once.get((term, edits), (0.0, 0.0))
                self.unseen[term, edits] = max(0.0, self._balanced(clean_once, toxic_once, KEEPS**edits * weight, GUESSED))

    def _balanced(self, clean: float, toxic: float, expected: float, texts: float) -> float:
        """Log ratio of the rates in both classes, with an expected weight counted as so many texts."""
        share = 1 / (1 + math.exp(-expected))
        return math.log((toxic + texts * share) / (clean * self.even + texts * (1 - share)))

    def __call__(self, term: int, edits: int, word: str, without: int | None = None) -> float:
        """The weight of a hit; ``without`` is the label of one text that is not to count."""
        if edits == 0:
            return self.exact[term]
        clean, toxic = self.seen.get((term, edits, word), (0.0, 0.0))
        if without is not None:
            clean, toxic = clean - (without == 0), toxic - (without == 1)
        return max(0.0, self._balanced(clean, toxic, self.unseen[term, edits], EXPECTED))


def _hit_rows(sample: DataFrame, terms: tuple[str, ...], column: str) -> DataFrame:
    """Labelled texts with their hits and number of words."""

    @F.pandas_udf("n bigint, hits array<struct<place:int,edits:int,term:int,quoted:boolean,word:string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = _finder(terms)
        for texts in batches:
            rows = [finder.hits(text) for text in texts]
            named = [[dict(zip(HIT, h, strict=True)) for h in hits] for hits, _ in rows]
            yield pd.DataFrame({"n": [n for _, n in rows], "hits": named})

    return sample.select("label", found(text_or_empty(column)).alias("f")).select("label", "f.n", "f.hits")


class Model:
    """A lexicon, the weights of its hits, and the logistic model."""

    def __init__(self, terms, weights, mean, spread, logistic):
        self.terms, self.weights = terms, weights
        self.mean, self.spread, self.logistic = mean, spread, logistic

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows, dtype=float).reshape(-1, len(FEATURES)) - self.mean) / self.spread
        return learning.logistic(x, self.logistic)


def fit(rows: DataFrame, key: str = "doc_id", column: str = "text", at_most: int = learning.SAMPLE_ROWS) -> Model:
    """A model from labelled rows; at most about ``at_most`` of them are used."""
    sample = cut_lineage(learning.bounded(rows.select(key, F.col(f"`{column}`").alias("text"), "label"), key, at_most))
    terms = learn_lexicon(sample)
    found = _hit_rows(sample, terms, "text").toPandas()
    y = found["label"].to_numpy(dtype=float)
    hits_of = [[tuple(h[name] for name in HIT) for h in hits] for hits in found["hits"]]
    weights = Weights(y, hits_of, len(terms))
    # A text's own label says nothing about the misspellings in it.
    rows_of = [
        features(hits, n, functools.partial(weights, without=int(label))) for hits, n, label in zip(hits_of, found["n"], y, strict=True)
    ]
    x = np.array(rows_of, dtype=float).reshape(-1, len(FEATURES))
    mean, spread = learning.standardised(x)
    return Model(terms, weights, mean, spread, learning.fit_logistic((x - mean) / spread, y))


def score(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """All columns of ``docs`` and the number of hits, of quoted hits, and the score from 0 to 1."""

    @F.pandas_udf("toxicity_hits bigint, toxicity_quoted bigint, toxicity_score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = _finder(model.terms)
        for texts in batches:
            found = [finder.hits(text) for text in texts]
            rows = [features(hits, n, model.weights) for hits, n in found]
            yield pd.DataFrame(
                {
                    NAMES[0]: [len(hits) for hits, _ in found],
                    NAMES[1]: [sum(h[3] for h in hits) for hits, _ in found],
                    NAMES[2]: model.score(rows),
                }
            )

    return with_results(docs, scored(text_or_empty(column)), NAMES)
