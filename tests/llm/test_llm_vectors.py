"""Operators on vectors and on two tokenizers beside brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from millrace.llm import align, compress, topk
from millrace.llm.vectors import blocks
from millrace.session import cut_lineage

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, score int, part string"


def some_vectors(seed, n, width, odd=True):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    if odd:
        same = rows[3][1]
        rows += [(1000 + i, same, 1) for i in range(60)]
        rows += [(20, rows[5][1], 0), (20, same, 2), (None, same, 2), (40, None, 1), (60, [0.5, None] * (width // 2), 1)]
        rows += [(80, [float("nan")] * width, 1), (100, [float("inf")] * width, 1), (120, [], 1), (140, [0.25] * (width - 3), None)]
    rng.shuffle(rows)
    return [(*row, "x", 7, "y") for row in rows]


def kept(rows, scale):
    def finite(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if finite(v)]


def plain_top(rows, k):
    codes = kept(rows, 64)
    out = []
    for at, (query, q, _) in enumerate(codes):
        if query is None or query % 20:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, c)), i is None, i or 0, i) for other, (i, c, _) in enumerate(codes) if other != at
        ]
        out += [(query, rank + 1, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "lists"), [(150, 2), (150, 3), (8, 2)])
def test_topk_beside_brute_force(spark, monkeypatch, n, lists):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 30)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rows = some_vectors(n, n, 10, odd=n > 10)
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_inner_products(df, F.col("vec_id") % 20 == 0, lists=lists).collect()
    assert sorted(map(tuple, got), key=repr) == plain_top(rows, 20)


def test_topk_of_nothing(spark):
    df = spark.createDataFrame(some_vectors(1, 5, 6, odd=False), SCHEMA)
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_inner_products(df, F.lit(False)).collect() == []
    assert topk.top_inner_products(df.limit(1), F.lit(True)).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        topk.top_inner_products(huge, F.lit(True))


def test_large_products_stay_exact():
    left = np.array([[2**29 + 1, -(2**29) - 3]])
    assert topk.products(left, left).tolist() == [[(2**29 + 1) ** 2 + (2**29 + 3) ** 2]]


def plain_codes(rows, parts, entries, rounds):
    codes = kept(rows, 4096)
    width = max(len(c) for _, c, _ in codes)
    width = -(-width // parts)
    codes = [(i, c + [0] * (parts * width - len(c)), label) for i, c, label in codes]
    codes.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[c[p * width : (p + 1) * width] for p in range(parts)] for _, c, _ in codes]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), at) for at, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for at, group in groups.items():
                books[p][at] = [sum(column) // len(group) for column in zip(*group)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = []
    for (i, _, label), c in zip(codes, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    total = Counter()
    for _, _, error, label in found:
        total[label] += error
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in found), key=repr)


@pytest.mark.parametrize(("n", "width"), [(200, 16), (7, 16), (90, 21)])
def test_codes_beside_brute_force(spark, monkeypatch, n, width):
    monkeypatch.setattr(compress, "BLOCK_ROWS", 64)
    rows = some_vectors(n, n, width, odd=n > 10)
    got = compress.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_codes(rows, 8, 16, 6)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame(some_vectors(1, 5, 6, odd=False), SCHEMA)
    assert compress.compress(df.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 1.0], 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(ValueError, match="too large"):
        compress.compress(huge)


def test_cover_tree_covers_and_decides_for_whole_subtrees():
    rng = np.random.default_rng(5)
    near = rng.integers(-5, 6, (400, 4)) + np.repeat(rng.integers(-4000, 4000, (8, 4)), 50, axis=0)
    points = np.concatenate([near, np.repeat(near[:1], 300, axis=0)])
    tree, order = compress.CoverTree.grow(points)
    assert sorted(order) == list(range(700)) and (tree.points == points[order]).all()
    for node in range(len(tree.start)):
        below = tree.points[tree.start[node] : tree.end[node]]
        assert compress.squared(below, below[0]).max() == tree.radius2[node]
        children = range(tree.child[node], tree.child[node] + tree.children[node])
        if children:
            assert [tree.start[c] for c in children] == [tree.start[node], *[tree.end[c] for c in children][:-1]]
            assert all(4 * tree.radius2[c] <= tree.radius2[node] for c in children)
    entries = rng.integers(-4000, 4000, (16, 4))
    runs = [run for found in tree.nearest(entries) for run in zip(*found)]
    best = compress.squared(tree.points[:, None], entries[None]).argmin(axis=1)
    seen = np.zeros(700, dtype=int)
    for start, end, entry in runs:
        seen[start:end] += 1
        assert (best[start:end] == entry).all()
    assert (seen == 1).all() and len(runs) < 300


def test_blocks_hold_every_row_once(spark):
    codes = cut_lineage(spark.range(500).select(F.col("id").alias("row"), F.array("id", F.lit(1).cast("bigint")).alias("codes")))
    found = blocks(codes, 7, 2, 2).collect()
    assert sorted(r for block in found for r in block["rows"]) == list(range(500))
    for block in found:
        assert block["parts"][0] == [x for r in block["rows"] for x in (r, 1)] and set(block["parts"][1]) == {0}


def plain_alignment(docs):
    first = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = align.byte_of_character()

    def pieces(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        sizes = [[len(bytes(byte[c] for c in first.id_to_token(i))) for i in a], []]
        joined = [b"".join(bytes(byte[c] for c in first.id_to_token(i)) for i in a), b""]
        for i in b:
            piece = second.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()
            sizes[1].append(len(raw))
            joined[1] += raw
        return (a, b, sizes) if joined[0] == joined[1] == (" " + text).encode() else ([], [], [[], []])

    linked = []
    for _, text in docs:
        a, b, sizes = pieces(text) if text else ([], [], [[], []])
        ends = [list(np.cumsum(s)) for s in sizes]
        links, groups = [], []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if ends[0][i] - sizes[0][i] < ends[1][j] and ends[1][j] - sizes[1][j] < ends[0][i]:
                    links.append((x, y))
        low = [0, 0]
        for end in sorted({*ends[0]} & {*ends[1]}):
            high = [ends[0].index(end) + 1, ends[1].index(end) + 1]
            groups.append("|".join(",".join(map(str, ids[low[s] : high[s]])) for s, ids in enumerate((a, b))))
            low = high
        linked.append((len(a), len(b), groups, links))
    counts = Counter(pair for *_, links in linked for pair in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (doc, _), (n_a, n_b, groups, links) in zip(docs, linked):
        best = sum(counts[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), digest, ";".join(groups)))
    return sorted(out, key=repr), counts


def test_alignment_beside_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_BYTES", 300)
    rng = random.Random(3)
    words = ["the", "Überraschung", "naïve", "don't", "日本語", "<|endoftext|>", "<unk>", "</s>", "😀", "x=1;", "straße", "12345", "\n"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a  b   c"), (103, " leading"), (104, "▁piece"), (105, "tab\there\x00 nul"), (106, "ﬁ ligature Å")]
    docs += [docs[3], docs[3], (None, "the the naïve"), (7, "other text of 7"), (107, "word " * 3000 + "end"), (108, "<0x41> A")]
    df = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in docs], "doc_id bigint, text string, n_a int, `key` string, chunk int")
    found = align.Alignment(df.repartition(3), with_groups=True)
    want, counts = plain_alignment([d for d in docs if d[0] != 107])
    long_text = docs[[d[0] for d in docs].index(107)][1]
    got = align.Alignment(df.where("doc_id IS DISTINCT FROM 107").repartition(3), with_groups=True)
    texts = {}
    for row in got.groups().collect():
        texts.setdefault(row["key"], set()).add(row["groups"])
    order = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [tuple(r[c] for c in order) for r in got.documents().collect()]
    assert sorted(rows, key=repr) == sorted((w[:-1] for w in want), key=repr)
    assert all(w[-1] in texts[w[0]] for w in want)
    pairs = {(r["a"], r["b"]): r["n_docs"] for r in got.pair_counts().collect()}
    assert pairs == dict(counts)
    whole = {r["key"]: r for r in found.documents().collect()}
    assert whole[107]["n_links"] == whole[107]["n_a"] + whole[107]["n_b"] - whole[107]["n_groups"] > len(long_text) / 6
    assert align.Alignment(df.limit(0)).documents().collect() == []
    blank = align.Alignment(df.where("text IS NULL OR text = ''")).documents().collect()
    assert {(r["n_a"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in blank} == {(0, 0, 0, 0, "")}


def test_byte_level_ids_are_those_of_the_public_library(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").collect()]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ours = align.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).encode(texts).to_pylist()
    assert ours == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
