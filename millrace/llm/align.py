"""Alignment of the tokens of two tokenizers over the same bytes.

Texts go through Arrow tables a few MB at a time. Both tokenizers' ids are list columns; flattened
lists with their parent indices give one row for each token, and a cumulative sum of the token
lengths, segmented by document, gives the byte offset at which it ends. A full outer hash join on
(document, end) puts the tokens of both sides in one order of ends. Ends that both sides have cut
the text into groups. Between two neighbouring ends lies exactly one pair of overlapping tokens,
the next one to end on each side: filling the gaps backwards lists all links of all documents. Grouped by
document and pair they give a partial count of documents for each pair, which Spark adds up over
the corpus; each batch gets back the counts of its own pairs and sums them for its documents.

Cases: texts that are null or empty, or whose tokens on either side do not join to a space and the
text, have no tokens: counts of zero and an empty digest. Special tokens have no meaning. Repeated
rows count as documents of their own. Very long texts make a batch of their own. An empty table
gives no rows. Columns other than the key and the text do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import prepare_workers
from millrace.session import cut_lineage

# Bytes of text that are aligned together.
CHUNK_BYTES = 2 * 1024 * 1024

# A pair is the first id times this, plus the second id.
SIDE = 1 << 32

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = ["key", *COUNTS, "n_best", "count_sum", "groups_sha256"]

# One row for each chunk: columns of its documents, and of the distinct pairs in it. ``places`` of
# all documents are one list of increments within each document.
CHUNK = pa.schema(
    [("chunk", pa.int64()), ("key", pa.list_(pa.int64()))]
    + [(name, pa.list_(pa.int64())) for name in COUNTS]
    + [
        ("groups", pa.list_(pa.string())),
        ("groups_sha256", pa.list_(pa.string())),
        ("n_pairs", pa.list_(pa.int32())),
        ("places", pa.list_(pa.int32())),
        ("times", pa.list_(pa.int32())),
        ("pairs", pa.list_(pa.int64())),
        ("n_docs", pa.list_(pa.int64())),
    ]
)
CHUNK_SQL = (
    "chunk bigint, key array<bigint>, "
    + ", ".join(f"{name} array<bigint>" for name in COUNTS)
    + ", groups array<string>, groups_sha256 array<string>, n_pairs array<int>, places array<int>, times array<int>"
    + ", pairs array<bigint>, n_docs array<bigint>"
)


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """The byte-level tokenizer of a JSON file: ids in order of their merges, encoded by rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        byte = byte_of_character()
        special = {token["content"] for token in described["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in described["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.token[i] = token

    def encode(self, texts: list[str]) -> pa.ListArray:
        return list_column([self.encoding.encode_to_numpy(" " + text) for text in texts])


class Pieces:
    """The pieces of a model file, which puts a space before each text by itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token = [
            bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> pa.ListArray:
        return list_column(self.model.encode(texts, num_threads=1))


def list_column(ids: list) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    joined = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined))


class Aligner:
    """Both tokenizers and their token bytes as Arrow arrays."""

    def __init__(self, first, second):
        self.sides = (first, second)
        self.token = [pa.array(side.token, pa.binary()) for side in self.sides]
        self.length = [pc.binary_length(token) for token in self.token]
        self.number = [pa.array([str(i) for i in range(len(token))]) for token in self.token]

    def tokens(self, texts: list[str]) -> tuple[list[pa.ListArray], pa.Array, pa.Array]:
        """The ids of each side, the wanted bytes, and which texts both sides reproduce."""
        ids = [side.encode(texts) for side in self.sides]
        wanted = pa.array([(" " + text).encode() for text in texts], pa.binary())
        same = pa.array([bool(text) for text in texts])
        for side, token in zip(ids, self.token, strict=True):
            joined = pc.binary_join(pa.ListArray.from_arrays(side.offsets, token.take(side.values)), b"")
            same = pc.and_(same, pc.equal(joined, wanted))
        return ids, wanted, same

    def ends(self, ids: pa.ListArray, start: pa.Array, side: int) -> pa.Table:
        """One row for each token: its document, the offset of its end in it, and its id."""
        token = pc.list_flatten(ids)
        doc = pc.list_parent_indices(ids)
        so_far = pc.cumulative_sum(pc.cast(self.length[side].take(token), pa.int64()))
        end = pc.subtract(so_far, start.take(doc))
        return pa.table({"doc": doc, "end": end, "ab"[side]: token})

    def align(self, texts: list[str], with_groups: bool) -> dict:
        """Columns of the documents and of the distinct pairs of one chunk."""
        ids, wanted, same = self.tokens(texts)
        ids = [side.filter(same) for side in ids]
        size = pc.cast(pc.binary_length(wanted.filter(same)), pa.int64())
        start = pc.subtract(pc.cumulative_sum(size), size)
        first, second = (self.ends(side, start, i) for i, side in enumerate(ids))
        both = first.join(second, ["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
        at = pc.add(start.take(both["doc"]), both["end"])
        both = both.take(pc.sort_indices(at))
        doc = both["doc"].to_numpy()
        shared = pc.and_(both["a"].is_valid(), both["b"].is_valid()).to_numpy()
        n = len(size)
        n_groups = np.bincount(doc[shared], minlength=n)
        counts = [np.diff(side.offsets.to_numpy()) if n else np.zeros(0, int) for side in ids]
        link = pc.add(
            pc.multiply(pc.cast(pc.fill_null_backward(both["a"]), pa.int64()), SIDE), pc.cast(pc.fill_null_backward(both["b"]), pa.int64())
        )
        linked = pa.table({"doc": both["doc"], "pair": link})
        linked = linked.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        partial = linked.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        # Common pairs come first, so that most places are small numbers.
        partial = partial.sort_by([("count_all", "descending"), ("pair", "ascending")])
        place = pc.index_in(linked["pair"], value_set=partial["pair"].combine_chunks()).to_numpy()
        owner = linked["doc"].to_numpy()
        order = np.lexsort((place, owner))
        place, owner = place[order], owner[order]
        steps = np.diff(place, prepend=0)
        n_pairs = np.bincount(owner, minlength=n)
        heads = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
        steps[heads] = place[heads]
        groups = self.groups(both, shared, n_groups)
        return {
            "same": same.to_numpy(zero_copy_only=False),
            "n_a": counts[0],
            "n_b": counts[1],
            "n_groups": n_groups,
            "n_links": np.bincount(doc, minlength=n),
            "groups": groups if with_groups else None,
            "groups_sha256": [hashlib.sha256(text.as_buffer()).hexdigest() for text in groups],
            "n_pairs": n_pairs,
            "places": steps,
            "times": linked["count_all"].to_numpy()[order],
            "pairs": partial["pair"].to_numpy(),
            "n_docs": partial["count_all"].to_numpy(),
        }

    def groups(self, both: pa.Table, shared: np.ndarray, n_groups: np.ndarray) -> pa.Array:
        """The groups of each document as one string."""
        sides = []
        for name, number in zip("ab", self.number, strict=True):
            column = both[name].combine_chunks()
            cuts = np.cumsum(column.is_valid().to_numpy(zero_copy_only=False))[shared]
            offsets = pa.array(np.concatenate([[0], cuts]).astype(np.int32))
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, number.take(column.drop_null())), ","))
        pairs = pc.binary_join_element_wise(*sides, "|")
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, pairs), ";")


@functools.lru_cache(maxsize=1)
def _aligner(byte_path: str, pattern: str, piece_path: str) -> Aligner:
    return Aligner(ByteLevel(byte_path, pattern), Pieces(piece_path))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of about CHUNK_BYTES of text at a time; a longer text stands alone."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if texts and size + len(text) > CHUNK_BYTES:
                yield pa.array(keys, pa.int64()), texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield pa.array(keys, pa.int64()), texts


def aligned(byte_path: str, pattern: str, piece_path: str, with_groups: bool):
    """One row for each chunk of documents."""

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, pattern, piece_path)
        first = TaskContext.get().partitionId() << 32
        for number, (keys, texts) in enumerate(chunks(batches)):
            found = aligner.align(texts, with_groups)
            where = np.flatnonzero(found["same"])
            row = {"chunk": first + number, "key": keys.to_pylist()}
            for name in [*COUNTS, "n_pairs"]:
                spread = np.zeros(len(texts), dtype=np.int64)
                spread[where] = found[name]
                row[name] = spread
            for name in ("groups", "groups_sha256"):
                values = np.full(len(texts), "", dtype=object)
                if found[name] is not None:
                    values[where] = found[name].to_pylist() if isinstance(found[name], pa.Array) else found[name]
                row[name] = values if name != "groups" or with_groups else None
            for name in ("places", "times", "pairs", "n_docs"):
                row[name] = found[name]
            columns = [pa.array([row[field.name]], field.type) for field in CHUNK]
            yield pa.RecordBatch.from_arrays(columns, schema=CHUNK)

    return of_chunks


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk, with the sums over the counts of their pairs."""
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        for at in range(batch.num_rows):
            values = {name: column[name][at].values for name in ["key", *COUNTS, "groups_sha256"]}
            lists = {name: column[name][at].values for name in ("n_pairs", "places", "times", "counts", "best")}
            n_pairs = lists["n_pairs"].to_numpy()
            steps = lists["places"].to_numpy().astype(np.int64)
            # Increments begin anew with each document: what came before is taken off again.
            ends = np.cumsum(n_pairs)
            total = np.concatenate([[0], np.cumsum(steps)])
            place = total[1:] - np.repeat(total[ends - n_pairs], n_pairs)
            times = lists["times"].to_numpy().astype(np.int64)
            for name, by in (("n_best", "best"), ("count_sum", "counts")):
                weight = (lists[by].to_numpy(zero_copy_only=False) if lists[by] is not None else np.zeros(0)).astype(np.int64)
                running = np.concatenate([[0], np.cumsum(times * weight[place])])
                values[name] = pa.array(running[ends] - running[ends - n_pairs])
            yield pa.RecordBatch.from_arrays([values[name] for name in RESULT], RESULT)


class Alignment:
    """The aligned corpus: its stored chunks and the corpus-wide counts of pairs."""

    def __init__(
        self,
        docs: DataFrame,
        key: str = "doc_id",
        column: str = "text",
        byte_path: str | None = None,
        piece_path: str | None = None,
        pattern: str = public_tokenizers.PATTERN,
        with_groups: bool = False,
    ):
        prepare_workers(docs.sparkSession)
        byte_path = byte_path or public_tokenizers.path("byte_bpe_50k.json")
        piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
        texts = docs.select(
            F.col(f"`{key}`").cast("bigint").alias("key"),
            F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("text"),
        )
        self.chunks = cut_lineage(texts.mapInArrow(aligned(byte_path, pattern, piece_path, with_groups), CHUNK_SQL))

    def _pairs(self) -> DataFrame:
        """One row for each chunk and distinct pair."""
        both = F.arrays_zip("pairs", "n_docs")
        return self.chunks.select("chunk", F.posexplode(both).alias("place", "one")).select(
            "chunk", "place", F.col("one.pairs").alias("pair"), F.col("one.n_docs").alias("n_docs")
        )

    def pair_counts(self) -> DataFrame:
        """``pair, a, b, n_docs, best``: in how many documents a pair is linked; best: no pair of a has more."""
        totals = self._pairs().groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
        a = F.expr(f"pair div {SIDE}L").alias("a")
        # A first id has at most as many pairs as the second vocabulary has entries.
        most = F.max("n_docs").over(Window.partitionBy("a"))
        totals = totals.select("pair", a, F.expr(f"pair % {SIDE}L").alias("b"), "n_docs")
        return totals.withColumn("best", F.col("n_docs") == most)

    def groups(self) -> DataFrame:
        """``key, groups``: every document's groups as text, if they were asked for."""
        both = F.arrays_zip("key", "groups")
        return self.chunks.select(F.explode(both).alias("one")).select("one.key", "one.groups")

    def documents(self) -> DataFrame:
        """Every document with its counts and the digest of its groups."""
        counts = self.pair_counts().select("pair", F.col("n_docs").alias("n"), "best")
        asked = self._pairs().select("chunk", "place", "pair").join(counts, "pair")
        one = F.array_sort(F.collect_list(F.struct("place", "n", "best")))
        answers = asked.groupBy("chunk").agg(one.alias("all")).select("chunk", F.col("all.n").alias("counts"), F.col("all.best").alias("best"))
        stored = self.chunks.drop("groups", "pairs", "n_docs").join(answers, "chunk", "left")
        types = "key bigint, " + ", ".join(f"{name} bigint" for name in [*COUNTS, "n_best", "count_sum"]) + ", groups_sha256 string"
        return stored.mapInArrow(summed, types)
