"""Secret scans: fixed patterns, and a small character network over every other candidate.

The patterns give base findings. What they leave of every run of token characters is a candidate if it
has six or more signs, words and numbers included, and a convolutional network in numpy scores its
characters with the text around it. The network is trained on labelled findings. Positive ones are the
values that the patterns found, as they are, without their surroundings, and with the value replaced by a made-up
one of another kind (other alphabets and lengths, drawn by a hash of the value), so that it learns more than
the form of the patterns. Negative ones are runs that are something else by their form: words, numbers
and addresses; runs that mix letters and digits otherwise are not labelled. Every different labelled value of
the corpus takes part, once, with one of its surroundings. A fourth of the values, by
their hash, takes no part in training with any of its forms: it calibrates the probabilities over
all pieces of a value, and sets the highest threshold that keeps the recall asked for. Candidates that reach
it are added as spans of kind ``net``.

Values are dealt to blocks by their hash; those of the label with fewer values go to several blocks, with
other made-up values in each, so that every block holds both labels. In a turn tasks train the network of the turn before
on one block each, and the mean of what they come to is the network of the next turn. All blocks
have been in a turn after the last one; few blocks are in several turns, a single one in all.

Cases: a null text is empty. Without both kinds of examples no network is trained and only
base findings are given. Texts are read whole; a long candidate is scored in overlapping
pieces and takes the highest score. Spans are code points, with the end exclusive. Repeated rows are scanned
each, an empty table gives no rows, and columns with the names of results give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm import learning
from millrace.llm.common import text_or_empty, with_results
from millrace.session import cut_lineage, scratch_dir

# The patterns of base findings, in the order of their kinds.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 6, 20

# Signs of a candidate, those that it neither begins nor ends with, and its least length.
ENDLESS = ".@!$%^&*~#"
RUN_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" + ENDLESS
NOT_RUN = re.compile("[^" + re.escape(RUN_SIGNS) + "]")
LEAST, LEAST_ALNUM = 6, 4
# The signs of a value that its hash is made of.
HASHED = 32

# Characters before and after a candidate, and of one piece of it.
BEFORE, INSIDE, AFTER = 20, 64, 8
LENGTH = BEFORE + INSIDE + AFTER
# Code points that are looked at together: what the filters make of them fits the cache of a core.
SLICE = 1 << 14
# Width and number of filters, turns of training.
WIDTH, FILTERS, EPOCHS = 5, 16, 14
# Labelled values of a block, blocks that are trained on at once (if there are enough for all turns), and
# the values of each label that a block holds, if there are so many.
BLOCK, AT_ONCE, LEAST_VALUES = 1 << 13, 2, 300
# Values that a task holds before it hands them on, and hashes of values that it knows as handed on.
HELD, KNOWN = 1 << 15, 1 << 19
# The mean of the blocks adds up whole multiples of this, so that it does not depend on their order.
GRAIN = 2.0**-40
# Characters beyond a window that its outermost filters still see.
EDGE = WIDTH // 2
SEED = 11
# Few labelled values are replaced several times, until there are about so many.
LEAST_FORMS = 300
# The share of labelled secrets that the threshold must keep.
RECALL = 0.98

# Classes of characters: the network sees these, not single characters.
_GROUPS = ["ae", "bcdf", "iou", "ghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "+/", "=", "_-", "\"'", ":", " \t\n\r", ".,;!?", "@#*$%&|<>()[]{}"]
CLASSES = len(_GROUPS) + 3
_TABLE = np.full(128, len(_GROUPS), dtype=np.int64)
for _number, _group in enumerate(_GROUPS):
    for _sign in _group:
        _TABLE[ord(_sign)] = _number
WIDE, PAD = len(_GROUPS) + 1, len(_GROUPS) + 2

# Bytes of UTF-8, with the digits of hexadecimal numbers made one sign.
_HEX_SIGNS = bytes(ord("0") if chr(b) in "0123456789abcdef" else 0 for b in range(256))


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of every base finding, by start and then by kind."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"0" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_SIGNS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(kind, start, end) for start, kind, end in sorted(found)]


def _signs(signs: str) -> bytes:
    """For ``bytes.translate``: 1 for some of the code points under 128."""
    return bytes(b < 128 and chr(b) in signs for b in range(256))


_RUN, _CORE = _signs(RUN_SIGNS), _signs("".join(sign for sign in RUN_SIGNS if sign not in ENDLESS))
_KINDS = {"digit": _signs("0123456789"), "lower": _signs("abcdefghijklmnopqrstuvwxyz"), "upper": _signs("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "@": _signs("@"), ".": _signs(".")}
_ALNUM = bytes(map(max, _KINDS["digit"], _KINDS["lower"], _KINDS["upper"]))
_CODES = bytes(_TABLE.tolist()) + bytes([WIDE]) * 128


class Stretch:
    """Some texts, or a part of a long one, as one array of code points, and the candidates in it.

    ``text``, ``start`` and ``end`` place each candidate, ``at`` and ``length`` give its place in the array.
    """

    def __init__(self, texts: list[str], parts: list[tuple[int, int, int]], base: list[list[tuple[int, int, int]]]):
        left = [max(0, low - BEFORE - EDGE) for _, low, _ in parts]
        strings = [texts[i][a : high + AFTER + EDGE] for a, (i, _, high) in zip(left, parts, strict=True)]
        gap = "\0" * (BEFORE + EDGE)
        raw = (gap + gap.join(strings) + gap).encode("utf-32-le", "surrogatepass")
        self.points = np.minimum(np.frombuffer(raw, dtype=np.uint32), 128).astype(np.uint8)
        self.bytes = self.points.tobytes()
        sizes = np.array([len(x) for x in strings], dtype=np.int64)
        first = len(gap) + np.cumsum(sizes + len(gap)) - (sizes + len(gap))
        self.codes = np.array(self._flags(_CODES, np.int8))
        run = np.array(self._flags(_RUN))
        self.codes[: len(gap)] = PAD
        for (i, low, high), a, size, place in zip(parts, left, sizes.tolist(), first.tolist(), strict=True):
            self.codes[place + size : place + size + len(gap)] = PAD
            run[place : place + low - a] = run[place + high - a : place + size] = False
            for _, start, end in base[i]:
                if start < high and end > low:
                    run[place + max(start, low) - a : place + min(end, high) - a] = False
        edges = np.flatnonzero(run[1:] != run[:-1]) + 1
        long = edges[1::2] - edges[::2] >= LEAST
        begin, stop = edges[::2][long], edges[1::2][long]
        core = self._flags(_CORE)
        cores = np.flatnonzero(core)
        if len(cores):
            late, early = np.flatnonzero(~core[begin]), np.flatnonzero(~core[stop - 1])
            begin[late] = np.append(cores, len(core))[np.searchsorted(cores, begin[late])]
            stop[early] = np.append(-1, cores)[np.searchsorted(cores, stop[early])] + 1
            # A run without any other sign has a begin after its stop now.
            long = stop - begin >= LEAST
            begin, stop = begin[long], stop[long]
        self.at, self.length = begin, stop - begin
        good = self._counted(_ALNUM) >= LEAST_ALNUM
        self.at, self.length = begin[good], (stop - begin)[good]
        part = np.searchsorted(first, self.at, side="right") - 1
        shift = np.array(left, dtype=np.int64) - first
        self.text = np.array([i for i, _, _ in parts], dtype=np.int64)[part] if len(parts) else np.zeros(0, dtype=np.int64)
        self.start = self.at + shift[part] if len(parts) else self.at
        self.end = self.start + self.length

    def _flags(self, signs: bytes, kind: type = bool) -> np.ndarray:
        return np.frombuffer(self.bytes.translate(signs), dtype=kind)

    def _counted(self, signs: bytes) -> np.ndarray:
        """How many of some signs each candidate has."""
        total = np.cumsum(self._flags(signs), dtype=np.int32)
        return total[self.at + self.length - 1] - total[self.at - 1]

    def count(self, name: str) -> np.ndarray:
        return self._counted(_KINDS[name])

    def ordinary(self) -> np.ndarray:
        """Candidates that are words, numbers or addresses by their form."""
        digits, lower, upper = (self.count(name) for name in ("digit", "lower", "upper"))
        capital = (upper == 1) & self._flags(_KINDS["upper"])[self.at]
        word = (digits == 0) & ((upper == 0) | capital | ((lower == 0) & (upper <= 12)))
        address = (self.count("@") == 1) & (self.count(".") >= 1)
        return word | (lower + upper == 0) | address

    def hashes(self) -> np.ndarray:
        """A hash of the first signs of each candidate."""
        place = np.arange(min(HASHED, self.length.max(initial=0)))
        held = place < self.length[:, None]
        points = self.points[np.minimum(self.at[:, None] + place, len(self.points) - 1)]
        return mixed(np.where(held, points + np.uint64(1), np.uint64(0)))


def mixed(points: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each row of numbers."""
    weights = np.random.default_rng(SEED).integers(1, 2**62, HASHED).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    # Rows may be cut where only zeros follow.
    total = (points.astype(np.uint64) * weights[: points.shape[1]]).sum(axis=1, dtype=np.uint64)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return ((total ^ (total >> np.uint64(32))) >> np.uint64(2)).astype(np.int64)


def hash_of(value: str) -> int:
    points = np.zeros((1, HASHED), dtype=np.uint64)
    points[0, : min(HASHED, len(value))] = [min(ord(sign), 128) + 1 for sign in value[:HASHED]]
    return int(mixed(points)[0])


def stretches(texts: list[str], base: list[list[tuple[int, int, int]]]) -> Iterator[Stretch]:
    """The texts in stretches of about ``SLICE`` code points; a long text is cut where no candidate is cut."""
    parts, size = [], 0
    for i, text in enumerate(texts):
        low = 0
        while low < len(text):
            high = low + SLICE
            if high < len(text):
                border = NOT_RUN.search(text, high)
                high = border.start() if border else len(text)
            high = min(high, len(text))
            parts.append((i, low, high))
            size += high - low
            if size >= SLICE:
                yield Stretch(texts, parts, base)
                parts, size = [], 0
            low = high
    if parts:
        yield Stretch(texts, parts, base)


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE - EDGE) : start], text[start:end], text[end : end + AFTER + EDGE]


EXAMPLE = "label int, number bigint, before string, value string, after string"


def examples(docs: DataFrame, column: str = "text") -> DataFrame:
    """``label, number, before, value, after``: all labelled findings; a task hands on most values once."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Values are told by hashes; that of a short ordinary one is there already.
        known: set[int] = set()
        held: list[tuple] = []
        for batch in batches:
            texts = batch["text"].tolist()
            base = [base_findings(text) for text in texts]
            for text, own in zip(texts, base, strict=True):
                for kind, start, end in own:
                    value = ASSIGN.match(text, start)[1] if kind == 0 else text[start:end]
                    key = hash((1, value))
                    if key not in known:
                        known.add(key)
                        where = text.rindex(value, start, end)
                        held.append((1, hash_of(value), *_around(text, where, where + len(value))))
            for stretch in stretches(texts, base):
                ordinary, numbers = np.flatnonzero(stretch.ordinary()), stretch.hashes()
                places = zip(stretch.text[ordinary].tolist(), stretch.start[ordinary].tolist(), stretch.end[ordinary].tolist(), strict=True)
                for (i, start, end), number in zip(places, numbers[ordinary].tolist(), strict=True):
                    key = number if end - start <= HASHED else hash((0, texts[i][start:end]))
                    if key not in known:
                        known.add(key)
                        held.append((0, number, *_around(texts[i], start, end)))
            if len(held) >= HELD:
                yield rows_of(held)
                held = []
            if len(known) >= KNOWN:
                known = set()
        yield rows_of(held)

    def rows_of(held: list[tuple]) -> pd.DataFrame:
        names = ["label", "number", "before", "value", "after"]
        return pd.DataFrame(dict(zip(names, map(list, zip(*held)), strict=True))) if held else pd.DataFrame([], columns=names)

    return docs.select(text_or_empty(column).alias("text")).mapInPandas(found, EXAMPLE)


# Alphabets of made-up values.
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!@#$%^&*",
)


def made_up(number: int, word: str) -> list[str]:
    """Values of other kinds, the same ones for the same number: random ones, and a word with signs and digits."""
    draw = np.random.default_rng(number)
    values = []
    for alphabet in ALPHABETS:
        signs = "".join(draw.choice(list(alphabet), size=draw.integers(10, 40)))
        values.append(signs if any(c.isdigit() for c in signs) else signs[:-1] + "7")
    letters = list(ALPHABETS[0][:52])
    values.append("".join(draw.choice(letters, size=draw.integers(16, 40))))
    swaps = str.maketrans({"a": "@", "o": "0", "i": "1", "s": "$", "e": "3"})
    values.append(word.capitalize().translate(swaps) + "!#_-"[draw.integers(4)] + str(draw.integers(10, 9999)))
    return values


def labelled_forms(rows: pd.DataFrame, draws: int | None = None, only: bool | None = None) -> list[tuple[int, bool, tuple[str, str, str]]]:
    """``label, held_out, (before, value, after)`` of every form of the labelled findings, or ``only`` those held out or not.

    Each secret is replaced ``draws`` times by made-up values of each kind, by other ones in each ``copy`` of its row.
    """
    plain, secret = rows[rows["label"] == 0], rows[rows["label"] == 1]
    forms = []
    around = list(zip(plain["before"], plain["after"], strict=True)) or [(" ", " ")]
    words = [w for w in plain["value"] if w.isascii() and w.isalpha()] or ["secret"]
    draws = draws or draws_for(len(secret))
    copies = secret["copy"] if "copy" in rows else [0] * len(secret)
    for number, before, value, after in zip(plain["number"], plain["before"], plain["value"], plain["after"], strict=True):
        held = number % 4 == 0
        if only in (None, held):
            forms += [(0, held, (before, value, after)), (0, held, (" ", value, " "))]
    for i, (row, copy) in enumerate(zip(secret.itertuples(), copies, strict=True)):
        held = row.number % 4 == 0
        if only not in (None, held):
            continue
        forms += [(1, held, (row.before, row.value, row.after)), (1, held, (" ", row.value, " "))]
        numbers = [row.number + copy * draws + draw for draw in range(draws)]
        made = [value for number in numbers for value in made_up(number, words[number % len(words)])]
        for j, value in enumerate(made):
            # With the surroundings of the value, and with those of some ordinary run.
            before, after = around[(row.number + j) % len(around)]
            forms.append((1, held, (row.before, value, row.after) if (i + j) % 2 else (before, value, after)))
    return forms


def draws_for(secrets: int) -> int:
    return max(1, -(-LEAST_FORMS // max(1, secrets)))


def pieces(before: str, value: str, after: str) -> list[tuple[np.ndarray, int]]:
    """Classes of the characters of each piece of a candidate, and the length of the piece."""
    out = []
    for start in range(0, max(1, len(value) - INSIDE // 2), INSIDE // 2):
        part = value[start : start + INSIDE]
        left = (before + value[:start])[-BEFORE - EDGE :]
        right = (value[start + INSIDE :] + after)[: AFTER + EDGE]
        codes = np.full(LENGTH + 2 * EDGE, PAD, dtype=np.int64)
        begin = BEFORE + EDGE
        for at, string in ((begin - len(left), left), (begin, part), (begin + len(part), right)):
            points = np.frombuffer(string.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            codes[at : at + len(points)] = np.where(points < 128, _TABLE[np.minimum(points, 127)], WIDE)
        out.append((codes, len(part)))
    return out


def coded(values: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the characters of all ``pieces`` of some values, the lengths of the pieces, and the value of each."""
    short = [i for i, (_, value, _) in enumerate(values) if len(value) <= INSIDE]
    edge = BEFORE + EDGE
    left = [values[i][0][-edge:] for i in short]
    right = [values[i][1] + values[i][2][: AFTER + EDGE] for i in short]
    # Where there is no text, spaces are written and then become PAD.
    raw = "".join([a.rjust(edge) + b.ljust(LENGTH + 2 * EDGE - edge) for a, b in zip(left, right, strict=True)]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, dtype=np.uint32).reshape(len(short), LENGTH + 2 * EDGE)
    codes = np.where(points < 128, _TABLE[np.minimum(points, 127)], WIDE)
    place = np.arange(LENGTH + 2 * EDGE) - edge
    first, last = (np.array([len(x) for x in side], dtype=np.int64)[:, None] for side in (left, right))
    codes = np.where((place >= -first) & (place < last), codes, PAD).astype(np.int8)
    lengths = np.array([max(1, len(values[i][1])) for i in short], dtype=np.int64)
    owner = np.array(short, dtype=np.int64)
    more = [(part, max(1, n), i) for i, value in enumerate(values) if len(value[1]) > INSIDE for part, n in pieces(*value)]
    if more:
        codes = np.concatenate([codes, np.array([part for part, _, _ in more], dtype=np.int8)])
        lengths, owner = np.append(lengths, [n for _, n, _ in more]), np.append(owner, [i for _, _, i in more])
    return codes, lengths, owner


class Net:
    """One convolution over character classes, pooled inside and around the candidate."""

    def __init__(self, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.filters = random.normal(0, 0.3, (WIDTH, CLASSES, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = random.normal(0, 0.1, 3 * FILTERS)
        self.shift = np.zeros(1)
        # The running means of gradients and of their squares, and the steps so far.
        self.moments = np.zeros((2, sum(p.size for p in self._params()))), 0
        self.tables: tuple[np.ndarray, np.ndarray] | None = None
        # Calibration of the last layer, the threshold, and the shares of held-out secrets and of others that reach it.
        self.scale, self.offset, self.threshold, self.recall, self.false_share = 1.0, 0.0, 0.5, 0.0, 0.0

    def _params(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.out, self.shift]

    def state(self) -> np.ndarray:
        """Parameters and moments as one array."""
        flat = np.concatenate([p.ravel() for p in self._params()])
        return np.concatenate([flat, self.moments[0].ravel()])

    def set_state(self, state: np.ndarray, steps: int) -> None:
        at = 0
        for p in self._params():
            p[...] = state[at : at + p.size].reshape(p.shape)
            at += p.size
        self.moments, self.tables = (state[at:].reshape(2, at).copy(), steps), None

    def _convolve(self, codes: np.ndarray) -> np.ndarray:
        """Filter, row, place."""
        width = codes.shape[1] - 2 * EDGE
        f = [np.ascontiguousarray(filters.T) for filters in self.filters]
        pairs = codes[:, :-1].astype(np.int64) * CLASSES + codes[:, 1:]
        # Two signs are looked up at once.
        total = (f[0][:, :, None] + f[1][:, None, :] + self.bias[:, None, None]).reshape(FILTERS, -1).take(pairs[:, :width], axis=1)
        total += (f[2][:, :, None] + f[3][:, None, :]).reshape(FILTERS, -1).take(pairs[:, 2 : width + 2], axis=1)
        total += f[4].take(codes[:, 4 : width + 4], axis=1)
        return total

    def _pools(self, codes: np.ndarray, lengths: np.ndarray):
        # Places that no row looks at are left out.
        codes = codes[:, : BEFORE + int(lengths.max()) + AFTER + 2 * EDGE]
        raw = self._convolve(codes)
        active = np.maximum(raw, 0)
        place = np.arange(raw.shape[2])
        end = BEFORE + lengths[:, None]
        inside = (place >= BEFORE) & (place < end)
        beside = (place < BEFORE) | ((place >= end) & (place < end + AFTER))
        within, around = active * inside, active * beside
        most_in, most_out = within.argmax(axis=2), around.argmax(axis=2)
        peak_in = np.take_along_axis(within, most_in[..., None], axis=2)[..., 0]
        peak_out = np.take_along_axis(around, most_out[..., None], axis=2)[..., 0]
        mean_in = within.sum(axis=2) / lengths.astype(raw.dtype)
        return codes, raw, inside, beside, most_in, most_out, np.vstack([peak_in, mean_in, peak_out]).T

    def raw_score(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._pools(codes, lengths)[-1] @ self.out + self.shift[0]

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the filters over the first three and the last two signs of a window, for all classes of them."""
        if self.tables is None:
            f = self.filters
            three = f[0][:, None, None] + f[1][None, :, None] + f[2][None, None, :] + self.bias
            two = f[3][:, None] + f[4][None, :]
            self.tables = three.reshape(-1, FILTERS).astype(np.float32), two.reshape(-1, FILTERS).astype(np.float32)
        return self.tables

    def stretch_scores(self, stretch: Stretch) -> np.ndarray:
        """The highest score over all pieces of each candidate of a stretch, in single precision.

        The filters run over the stretch once; windows of neighbours share what they see.
        """
        if not len(stretch.at):
            return np.zeros(0)
        three, two = self._tables()
        codes = stretch.codes.astype(np.int32)
        pairs = codes[:-1] * CLASSES + codes[1:]
        active = np.zeros((len(codes), FILTERS), dtype=np.float32)
        middle = active[EDGE : len(codes) - EDGE]
        np.take(three, pairs[: len(middle)] * CLASSES + codes[2 : len(middle) + 2], axis=0, out=middle, mode="clip")
        middle += two.take(pairs[3 : len(middle) + 3], axis=0)
        np.maximum(middle, 0, out=middle)
        # The maxima over the next 4, 8 and 16 signs; two of them that overlap cover any other width.
        most = {1: active}
        for width in (2, 4, 8, 16):
            half = most[width // 2]
            most[width] = np.maximum(half[: -(width // 2)], half[width // 2 :])
        # The mean is only needed under its weights, so the weighted sums of signs are added up.
        total = np.concatenate([[0], np.cumsum(active @ self.out[FILTERS : 2 * FILTERS].astype(np.float32), dtype=float)])

        n_pieces = np.maximum(1, -(-(stretch.length - INSIDE // 2) // (INSIDE // 2)))
        owner = np.repeat(np.arange(len(n_pieces)), n_pieces)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        at = stretch.at[owner] + step * (INSIDE // 2)
        end = np.minimum(at + INSIDE, stretch.at[owner] + stretch.length[owner])
        inside = np.empty((len(at), FILTERS), dtype=np.float32)
        for width, (low, high) in {4: (LEAST, 8), 8: (8, 16), 16: (16, INSIDE + 1)}.items():
            some = np.flatnonzero((end - at >= low) & (end - at < high))
            inside[some] = np.maximum(most[width][at[some]], most[width][end[some] - width])
        # A piece of over 32 signs has a middle that the first and the last 16 leave out.
        some = np.flatnonzero(end - at > 32)
        for place in (at[some] + 16, end[some] - 32):
            inside[some] = np.maximum(inside[some], most[16][place])
        beside = np.maximum(most[16][at - BEFORE], most[16][at - 16])
        beside = np.maximum(beside, most[8][end])
        mean = (total[end] - total[at]) / (end - at)
        scores = inside @ self.out[:FILTERS] + mean + beside @ self.out[2 * FILTERS :] + self.shift[0]
        best = np.full(len(n_pieces), -np.inf)
        np.maximum.at(best, owner, scores)
        return best

    def stretch_probabilities(self, stretch: Stretch) -> np.ndarray:
        """Calibrated probability of each candidate of a stretch."""
        return self.calibrated(self.stretch_scores(stretch))

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * scores + self.offset, -30, 30)))

    def train(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, passes: int = EPOCHS, seed: int = SEED + 1) -> None:
        """Adam over small batches, in single precision; both classes weigh the same."""
        random = np.random.default_rng(seed)
        single = np.float32
        self.filters, self.bias, self.out, self.shift = (p.astype(single) for p in self._params())
        params, (flat, step) = self._params(), self.moments
        cuts = np.cumsum([p.size for p in params])[:-1]
        first, second = ([part.reshape(p.shape).astype(single) for p, part in zip(params, np.split(m, cuts), strict=True)] for m in flat)
        weight = (np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)).astype(single)
        labels = labels.astype(single)
        for _ in range(passes):
            order = random.permutation(len(labels))
            for start in range(0, len(order), 128):
                batch = order[start : start + 128]
                grads = self._gradients(codes[batch], lengths[batch], labels[batch], weight[batch])
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.filters, self.bias, self.out, self.shift = (p.astype(float) for p in params)
        self.moments = np.array([np.concatenate([m.ravel() for m in part]) for part in (first, second)], dtype=float), step
        self.tables = None

    def _gradients(self, codes, lengths, labels, weight):
        codes, raw, inside, beside, most_in, most_out, pooled = self._pools(codes, lengths)
        score = pooled @ self.out + self.shift[0]
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * weight / len(labels)
        error = error.astype(raw.dtype)
        d_out = pooled.T @ error + 1e-4 * self.out
        d_pool = self.out[:, None] * error
        d_raw = (d_pool[FILTERS : 2 * FILTERS] / lengths.astype(raw.dtype))[..., None] * inside
        for most, flags, part in ((most_in, inside, d_pool[:FILTERS]), (most_out, beside, d_pool[2 * FILTERS :])):
            at = most[..., None]
            held = flags[np.arange(len(codes)), most] * part
            np.put_along_axis(d_raw, at, np.take_along_axis(d_raw, at, axis=2) + held[..., None], axis=2)
        d_raw *= raw > 0
        row, place = np.nonzero(d_raw.any(axis=0))
        flat = d_raw[:, row, place]
        one_of = np.eye(CLASSES, dtype=raw.dtype)
        d_filters = np.stack([(flat @ one_of[codes[row, place + k]]).T for k in range(WIDTH)])
        return d_filters, flat.sum(axis=1), d_out, np.array([error.sum()])

    def best_scores(self, values: list[tuple[str, str, str]]) -> np.ndarray:
        """The highest score over all pieces of each ``before, value, after``."""
        codes, lengths, owner = coded(values)
        best = np.full(len(values), -np.inf)
        for i in range(0, len(codes), 512):
            np.maximum.at(best, owner[i : i + 512], self.raw_score(codes[i : i + 512], lengths[i : i + 512]))
        return best

    def probabilities(self, values: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated probability of each ``before, value, after``."""
        if not values:
            return np.zeros(0)
        return self.calibrated(self.best_scores(values))


DEALT = f"block bigint, turn bigint, copy bigint, {EXAMPLE}"


def dealt(labelled: DataFrame) -> tuple[DataFrame | None, int, int, int]:
    """Every labelled value once, dealt to blocks and these to turns, stored; blocks, groups of turns and draws.

    A value whose label has few goes to several blocks, each time as another ``copy``.
    """
    rows = cut_lineage(labelled.dropDuplicates(["label", "number", "value"]))
    counts = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    if min(counts.get(label, 0) for label in (0, 1)) < 8:
        return None, 0, 0, 0
    blocks = -(-sum(counts.values()) // BLOCK)
    groups = min(max(blocks // AT_ONCE, 1), EPOCHS)
    times = [min(blocks, -(-blocks * LEAST_VALUES // counts[label])) for label in (0, 1)]
    each = F.when(F.col("label") == 1, times[1]).otherwise(times[0])
    block = F.pmod(F.xxhash64("number") + F.col("copy"), F.lit(blocks))
    placed = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), each.cast("bigint") - 1))).withColumn("block", block)
    placed = placed.withColumn("turn", F.col("block") % groups)
    path = scratch_dir(rows.sparkSession, "examples")
    placed.write.partitionBy("turn").parquet(path)
    return rows.sparkSession.read.parquet(path), blocks, groups, draws_for(counts[1])


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["label", "number", "value"], kind="stable", ignore_index=True)


def trained(rows: DataFrame, net: Net, draws: int, passes: int, seed: int) -> None:
    """The mean of what ``net`` comes to on each block of ``rows``."""
    start, steps, names = net.state(), net.moments[1], ["block", "steps", "state"]

    def of_block(block: pd.DataFrame) -> pd.DataFrame:
        forms = labelled_forms(in_order(block), draws, only=False)
        labels = np.array([label for label, _, _ in forms], dtype=float)
        if not 0 < labels.sum() < len(labels):
            return pd.DataFrame([], columns=names)
        own = Net()
        own.set_state(start, steps)
        codes, lengths, owner = coded([value for _, _, value in forms])
        own.train(codes, lengths, labels[owner], passes, seed)
        grains = np.round(own.state() / GRAIN).astype(np.int64)
        return pd.DataFrame([(int(block["block"].iloc[0]), own.moments[1], grains)], columns=names)

    states = rows.groupBy("block").applyInPandas(of_block, "block bigint, steps bigint, state array<bigint>")
    summed = states.select("steps", F.posexplode("state").alias("at", "part")).groupBy("at").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"), F.max("steps").alias("steps")
    )
    found = sorted(tuple(row) for row in summed.collect())
    if found:
        net.set_state(np.array([float(total) / n for _, total, n, _ in found]) * GRAIN, found[0][3])


def fit(labelled: DataFrame) -> Net | None:
    """A network from labelled findings (``examples``), all of them."""
    rows, blocks, groups, draws = dealt(labelled)
    if rows is None:
        return None
    net, start = Net(), Net().state()
    if blocks == 1:
        trained(rows, net, draws, EPOCHS, SEED + 1)
    else:
        for turn in range(EPOCHS):
            trained(rows.where(F.col("turn") == turn % groups), net, draws, 1, SEED + 1 + turn)
    if (net.state() == start).all():
        return None

    def held_out(block: pd.DataFrame) -> pd.DataFrame:
        # A value is judged once; its other copies are of use in training only.
        forms = labelled_forms(in_order(block[block["copy"] == 0]), draws, only=True)
        scores = net.best_scores([value for _, _, value in forms])
        return pd.DataFrame({"label": [label for label, _, _ in forms], "score": scores})

    return calibrate(net, cut_lineage(rows.groupBy("block").applyInPandas(held_out, "label int, score double")))


def calibrate(net: Net, scores: DataFrame) -> Net | None:
    """Probabilities and the threshold from the scores of all values held out."""
    n, positive, center, spread = scores.agg(F.count("*"), F.sum("label"), F.avg("score"), F.stddev_pop("score")).first()
    if not n or not 0 < positive < n:
        return None
    center, spread = round(center, 6), max(round(spread, 6), 1e-6)
    slope, shift = learning.fit_logistic_rows(scores.select(((F.col("score") - center) / spread).alias("x"), F.col("label").alias("y")))
    # Higher scores never mean a lower probability, however few values are held out.
    net.scale = max(float(slope), 1e-3) / spread
    net.offset = float(shift) - net.scale * center
    place = int((1 - RECALL) * positive)
    ascending = scores.where("label = 1").select("score").orderBy("score").rdd.zipWithIndex()
    least = ascending.filter(lambda entry: entry[1] == place).first()[0]["score"]
    net.threshold = float(net.calibrated(np.array([least]))[0])
    reach = (F.col("score") >= least).cast("double")
    net.recall, net.false_share = scores.agg(F.avg(F.when(F.col("label") == 1, reach)), F.avg(F.when(F.col("label") == 0, reach))).first()
    return net


NAMES = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]


def scan(docs: DataFrame, net: Net | None, column: str = "text") -> DataFrame:
    """All columns of ``docs`` with counts and spans; both kinds of spans are ``kind:start:end``, joined by commas."""

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            base = [base_findings(text) for text in texts]
            more = [[(start, kind, end) for kind, start, end in own] for own in base]
            for stretch in stretches(texts, base) if net is not None else ():
                for at in np.flatnonzero(net.stretch_probabilities(stretch) >= net.threshold):
                    more[stretch.text[at]].append((int(stretch.start[at]), len(KINDS) - 1, int(stretch.end[at])))
            rows = []
            for own, every in zip(base, more, strict=True):
                own = [(start, kind, end) for kind, start, end in own]
                said = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(part)) for part in (own, every)]
                rows.append((*[sum(k == kind for _, k, _ in own) for kind in range(3)], *said))
            yield pd.DataFrame(rows, columns=NAMES)

    return with_results(docs, scanned(text_or_empty(column)), NAMES)


def secret_scan(docs: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text if not given) with counts and spans."""
    kept = keep or [c for c in docs.columns if c != column and c.lower() not in NAMES]
    return scan(docs, fit(examples(docs, column)), column).select(*[F.col(f"`{c}`") for c in [*kept, *NAMES]])
