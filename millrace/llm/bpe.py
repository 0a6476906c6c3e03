"""Byte-level BPE by the rank files of public tokenizers, encoding and decoding.

Texts are cut by the tokenizer's pattern. Each distinct piece of a batch is encoded once: a segment
tree over its byte positions stores the leftmost minimum pair rank, and each merge updates the
leaves of the live neighbours and their ancestors. The trees of all new pieces of one size
class are kept in one numpy array and merge in step, so a batch of pieces costs a few array
operations per merge. Encoded pieces are remembered in each worker up to a bound.

Cases: a null text is empty and has no ids; its digests are those of no bytes. Texts are
encoded whole, whatever their length. Result columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import text_or_empty, with_results

NAMES = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
SCHEMA = "n_tokens bigint, ids string, ids_sha256 string, decoded_sha256 string"

# Pieces that a worker remembers, and the longest of them; others are encoded again.
CACHE_PIECES = 700_000
CACHE_CHARS = 64
# Characters of texts that are encoded together.
GROUP_CHARS = 1 << 20
# Pieces of more bytes have a tree of their own.
LONG_BYTES = 256
# Bytes of pieces whose trees are built at once.
TREE_BYTES = 1 << 17
# Positions in a piece take the low bits of a key, ranks the bits above; NONE sorts after all of them.
PLACE_BITS = 8
PLACE_MASK = (1 << PLACE_BITS) - 1
NONE = (1 << 31) - 1
# Positions and no pair in the tree of one long piece, whose keys are Python's own integers.
LONG_PLACE_BITS = 40
LONG_NONE = 1 << 80
# An odd number near 2^64 divided by the golden ratio spreads keys over the slots of a table.
MIX = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """A rank file: token bytes by id, and the rank of every pair of ids that forms a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {str(rank): token for token, rank in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        self.size = max(self.rank.values()) + 1
        keys, ranks = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    ranks.append(rank)
        self.keys, self.values = np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32)
        self._build_slots()

    def _build_slots(self) -> None:
        """An open hash table of pairs: slot by multiplied key, then the next free one."""
        self.bits = max(4, (8 * len(self.keys)).bit_length())
        self.slot_keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.slot_ranks = np.zeros((1 << self.bits) + 64, dtype=np.int32)
        slots, taken, self.probes = self._slots(self.keys).tolist(), set(), 1
        for i, slot in enumerate(slots):
            probes = 1
            while slot in taken:
                slot, probes = slot + 1, probes + 1
            taken.add(slot)
            self.slot_keys[slot], self.slot_ranks[slot] = self.keys[i], self.values[i]
            self.probes = max(self.probes, probes)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``rank, place`` of each pair in one number, or NONE where the pair forms no token."""
        wanted = left.astype(np.int64) * self.size + right
        slot = self._slots(wanted)
        out = np.full(wanted.shape, NONE, dtype=np.int32)
        open_ = np.arange(wanted.size)
        for _ in range(self.probes):
            there = self.slot_keys[slot]
            hit = there == wanted
            out[open_[hit]] = self.slot_ranks[slot[hit]] << PLACE_BITS | place[open_[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            open_, wanted, slot = open_[more], wanted[more], slot[more] + 1
        return out

    def merge(self, pieces: list[bytes]) -> list[str]:
        """Ids of each piece, in decimal and joined by spaces."""
        out = [""] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is None:
                todo.append(i)
            else:
                out[i] = str(whole)
        for i in todo:
            if len(pieces[i]) > LONG_BYTES:
                out[i] = self._merge_long(pieces[i])
        todo = sorted((i for i in todo if len(pieces[i]) <= LONG_BYTES), key=lambda i: len(pieces[i]))
        start = 0
        while start < len(todo):
            # Pieces of one size class, so that all trees of a group have the same height.
            leaves = 1 << max(1, (len(pieces[todo[start]]) - 1).bit_length())
            end = start + 1
            most = max(1, TREE_BYTES // leaves)
            while end < len(todo) and end - start < most and len(pieces[todo[end]]) <= leaves:
                end += 1
            group = todo[start:end]
            for i, ids in zip(group, self._merge_group([pieces[i] for i in group], leaves), strict=True):
                out[i] = ids
            start = end
        return out

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))

    def _merge_long(self, piece: bytes) -> str:
        """One long piece: the same tree in plain lists, where single updates are cheaper."""
        n = len(piece)
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        leaves = 1 << (n - 1).bit_length()
        none, pairs, size = LONG_NONE, self.pairs, self.size

        def key(at: int) -> int:
            other = after[at]
            rank = pairs.get(ids[at] * size + ids[other]) if other >= 0 else None
            return none if rank is None else rank << LONG_PLACE_BITS | at

        tree = [none] * leaves + [key(at) for at in range(n)] + [none] * (leaves - n)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            best = tree[1]
            at = best & (1 << LONG_PLACE_BITS) - 1
            gone = after[at]
            ids[at], ids[gone] = best >> LONG_PLACE_BITS, -1
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            put(gone, none)
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        return " ".join(str(i) for i in ids if i >= 0)

    def _merge_group(self, pieces: list[bytes], leaves: int) -> list[str]:
        """Merge pieces of at most ``leaves`` bytes in step, each with a segment tree of that many leaves.

        All arrays are flat: row r has its bytes at ``r * leaves`` and its tree at ``2 * r * leaves``.
        """
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int32, count=n)[:, None]
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(n, leaves)
        place = np.arange(leaves, dtype=np.int32)
        ids = np.where(place < lengths, self.byte[raw], -1)
        after = np.where(place + 1 < lengths, place + 1, -1).ravel()
        before = np.tile(place - 1, n)
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int32)
        inner = np.broadcast_to(place[:-1], (n, leaves - 1))
        pairs = self.pair_keys(ids[:, :-1].ravel(), np.maximum(ids[:, 1:], 0).ravel(), inner.ravel())
        tree[:, leaves : 2 * leaves - 1] = np.where(place[1:] < lengths, pairs.reshape(n, leaves - 1), NONE)
        width = leaves
        while width > 1:
            level = tree[:, width : 2 * width]
            width //= 2
            np.minimum(level[:, 0::2], level[:, 1::2], out=tree[:, width : 2 * width])
        ids, tree = ids.ravel(), tree.ravel()
        row = np.arange(n)
        while True:
            best = tree[2 * leaves * row + 1]
            open_rows = best != NONE
            row, best = row[open_rows], best[open_rows]
            if not row.size:
                break
            base = row * leaves
            at = best & PLACE_MASK
            gone = after[base + at]
            following = after[base + gone]
            ids[base + at] = best >> PLACE_BITS
            ids[base + gone] = -1
            after[base + at] = following
            self._put(tree, base, gone, NONE, leaves)
            some = following >= 0
            before[(base + following)[some]] = at[some]
            right = np.where(some, following, 0)
            key = np.where(some, self.pair_keys(ids[base + at], ids[base + right], at), NONE)
            self._put(tree, base, at, key, leaves)
            prior = before[base + at]
            some = prior >= 0
            base, at, prior = base[some], at[some], prior[some]
            self._put(tree, base, prior, self.pair_keys(ids[base + prior], ids[base + at], prior), leaves)
        words = ids.reshape(n, leaves)
        return [" ".join(map(str, row[row >= 0].tolist())) for row in words]

    @staticmethod
    def _put(tree: np.ndarray, base: np.ndarray, at: np.ndarray, key: np.ndarray | int, leaves: int) -> None:
        """Set one leaf of each tree and recompute its ancestors."""
        top = 2 * base
        node = at + leaves
        tree[top + node] = key
        while leaves > 1:
            leaves //= 2
            node = node >> 1
            low = top + 2 * node
            tree[top + node] = np.minimum(tree[low], tree[low + 1])


class Encoder:
    """Ranks, the pattern and the remembered pieces of one worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, str] = {}

    def encode(self, texts: list[str]) -> Iterator[str]:
        """The ids of each text, in decimal and joined by spaces.

        Texts are taken together up to a number of characters, so that their new pieces merge
        in few array operations.
        """
        start = 0
        while start < len(texts):
            end, chars = start + 1, len(texts[start])
            while end < len(texts) and chars + len(texts[end]) <= GROUP_CHARS:
                chars += len(texts[end])
                end += 1
            yield from self._encode_group(texts[start:end])
            start = end

    def _encode_group(self, texts: list[str]) -> Iterator[str]:
        cut = [self.pattern.findall(text) for text in texts]
        distinct = set().union(*cut)
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(distinct)
        self.known.update(zip(new, self.ranks.merge([piece.encode() for piece in new]), strict=True))
        for pieces in cut:
            yield " ".join(map(self.known.__getitem__, pieces))
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del self.known[piece]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(
    docs: DataFrame,
    column: str = "text",
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens, ids, ids_sha256, decoded_sha256``.

    ``ids`` are decimal, joined by single spaces; ``ids_sha256`` is the digest of that string and
    ``decoded_sha256`` that of the bytes decoded from it. Special tokens have no meaning here.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf(SCHEMA)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, pattern)
        for texts in batches:
            rows = []
            for ids in encoder.encode(texts.tolist()):
                rows.append(
                    (
                        ids.count(" ") + 1 if ids else 0,
                        ids,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(encoder.decode(ids)).hexdigest(),
                    )
                )
            yield pd.DataFrame(rows, columns=NAMES)

    return with_results(docs, encoded(text_or_empty(column)), NAMES)
