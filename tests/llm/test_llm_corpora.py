"""Operators over whole corpora beside brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, learning, ngram_join, queries, toxicity
from millrace.llm.common import prepare_workers


@pytest.fixture(scope="module")
def ready(spark):
    prepare_workers(spark)
    return spark


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_hits(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, text in items:
        words = re.findall(pattern, lower(text))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        words = re.findall(pattern, lower(text))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                ids = windows.get(tuple(words[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc, len(words), len(hit), len(found), ",".join(sorted("" if f is None else str(f) for f in found))))
    return sorted(out, key=repr)


def test_decontamination_beside_brute_force(ready):
    rng = random.Random(6)
    vocabulary = ["Uno", "dos", "trés", "4", "cinco", "SEIS", "ñu"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([30, 12, 10, 9, 4, 25, 11, 40])] + [(50, None), (51, "--"), (None, " ".join(some(15))), (1, "seis seis ñu uno")]
    docs = []
    for i in range(60):
        words = some(rng.randrange(80))
        source = rng.choice(items)[1] or ""
        cut = source.split()[rng.randrange(3) : 3 + rng.randrange(40)]
        at = rng.randrange(len(words) + 1)
        docs.append((i if i % 9 else None, ", ".join(words[:at] + cut + words[at:])))
    docs += [(7, None), (7, ""), docs[5], docs[5], (8, " ".join(items[0][1].split()) + " long" * 20_000)]
    df = ready.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, n_hit int")
    bench = ready.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(df, bench)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in found.collect()), key=repr)
    assert got == plain_hits(docs, items)
    assert {r["contaminated"] == (r["n_hit"] > 0) for r in found.collect()} == {True}
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(df, bench.limit(0)).collect()} == {0}


def plain_sets(docs):
    out = []
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        grams = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())
        out.append((doc, grams))
    return out


def plain_components(docs):
    sets = plain_sets(docs)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(grams), least[root(i)]) for i, (doc, grams) in enumerate(sets)]


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"t{rng.randrange(40)}" for _ in range(n))
    common = fresh(60)
    texts = [fresh(rng.randrange(4, 120)) for _ in range(20)]
    texts += copies(rng, fresh(150), 40, 9) + copies(rng, fresh(90), 15, 2) + [fresh(12)] * 12
    texts += [common + " " + fresh(rng.randrange(5, 60)) for _ in range(30)]
    chain = fresh(200).split()
    for step in range(12):
        texts.append(" ".join(chain[: 200 - 0] if step == 0 else chain))
        chain = chain[:]
        for _ in range(3):
            chain[rng.randrange(200)] = f"c{step}{rng.randrange(10**5)}"
    texts += ["", " \n ", "one", "ONE", "two words", "two  words", "a b c d", "É b c d", "é b c d"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[i], t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_beside_brute_force(ready, seed):
    docs = corpus(seed)
    df = ready.createDataFrame(docs, "doc_id bigint, text string")
    found = ngram_join.jaccard_components(df)
    got = sorted((r["doc"], r["n_shingles"], r["component_id"]) for r in found.collect())
    assert got == sorted(plain_components(docs))
    assert len({c for _, n, c in got if n}) < len(got) - 40


def test_jaccard_rounds_move_only_sets_of_pairs(ready, monkeypatch):
    docs = corpus(3)
    calls = []
    plain = ngram_join.intersected

    def watched(pairs, orders, percent):
        classes = pairs.select("cls").union(pairs.select("pivot")).distinct()
        calls.append((classes.count(), orders.count()))
        return plain(pairs, orders, percent)

    monkeypatch.setattr(ngram_join, "intersected", watched)
    found = ngram_join.jaccard_components(ready.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted((r["doc"], r["n_shingles"], r["component_id"]) for r in found.collect()) == sorted(plain_components(docs))
    assert calls and all(moved == met for met, moved in calls)


def test_jaccard_keeps_one_of_each_group(ready):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (3, text + " "), (9, None), (9, ""), (None, text), (None, "alone in the id less world"), (None, "alone in the id less world"), (4, "x")]
    df = ready.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, cls int")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, text + " "), (9, None), (9, ""), (None, "alone in the id less world"), (4, "x")], key=repr)
    assert ngram_join.keep_one(df.limit(0)).count() == 0
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_keeps_unlinked_texts_under_one_id(ready):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    df = ready.createDataFrame([(1, a, "x"), (1, b, "y"), (2, b, "z"), (2, a + " a41", "w"), (3, None, "v")], "doc_id bigint, text string, root string")
    got = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect() if r["text"])
    assert got == [(1, a), (1, b)]
    # The session is as it was, after an error too.
    before = ready.conf.get(ngram_join.CLEAN_SHUFFLES, None)
    with pytest.raises(Exception):
        ngram_join.jaccard_components(df.withColumn("text", F.raise_error(F.lit("broken"))))
    assert ready.conf.get(ngram_join.CLEAN_SHUFFLES, None) == before


def test_parity_bits_bound_the_difference(ready):
    rng = random.Random(8)
    rows = [(i, sorted(rng.sample(range(3000), rng.randrange(1, 900)))) for i in range(60)]
    sets = ready.createDataFrame(rows, "cls bigint, tokens array<bigint>")
    bits = {r["cls"]: list(r["bits"]) for r in ngram_join.parity(sets).collect()}
    for i, a in rows:
        for j, b in rows:
            differ = sum((x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(bits[i], bits[j]))
            assert differ <= len(set(a) ^ set(b)) and (i != j or differ == 0)


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_trie_beside_edit_distances():
    terms = ("idiot", "worthless", "scum", "moron", "abcdefghijk", "lowe*", "stupendous*")
    trie = toxicity.FuzzyTrie(terms)
    rng = random.Random(3)
    words = list(terms) + ["idi0t", "idot", "lower", "low", "stupendouxly", "abcdfghijjk", "", "é" * 30]
    for term in terms:
        for _ in range(60):
            letters = list(term.rstrip("*"))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randrange(2)] = rng.choice(["", "x", "o"])
            words.append("".join(letters) + rng.choice(["", "", "zz"]))
    for word in words:
        best = []
        for number, term in enumerate(terms):
            allowed = toxicity.allowed_edits(term)
            if term.endswith("*"):
                edits = min(edits_between(word[:k], term[:-1]) for k in range(len(word) + 1))
            else:
                edits = edits_between(word, term)
            if edits <= allowed:
                best.append((edits, number))
        found = trie.find(word)
        assert (found is None) == (not best) and (found is None or found[0] == min(best)[0]), word


def test_lexicon_keeps_words_for_their_misspellings(ready):
    rng = random.Random(21)
    plain = lambda n: " ".join(rng.choice("the a house tree river stone walks under over by".split()) for _ in range(n))
    endings = ["ary", "esque", "inate", "olent", "urnal", "ybdis"]
    toxic = [f"{plain(9)} you {rng.choice(['idiot', 'pathetic', 'worthless'])} {plain(6)} {i}" for i in range(90)]
    toxic += [f"{plain(9)} you zorg{rng.choice(endings)} {plain(6)} {i}" for i in range(60)]
    texts = [plain(rng.randrange(5, 60)) + f" {i}" for i in range(400)] + toxic
    df = ready.createDataFrame([(t, int(i >= 400)) for i, t in enumerate(texts)], "text string, label int")
    terms = toxicity.learn_lexicon(df)
    assert {"idiot", "pathetic", "worthless", "zorg*"} <= set(terms)
    assert not [term for term in terms if term.endswith("*") and not term.startswith("zorg")]
    trie = toxicity.FuzzyTrie(terms)
    assert all(trie.find(w) for w in ("1diot", "idjot", "id!ot", "pathetlc", "qathetic", "w0rthless", "zorgling"))
    assert not any(trie.find(w) for w in ("pathway", "path", "worth", "worthwhile", "idiosyncratic", "idiolect"))


def test_unseen_misspellings_count_like_their_term(ready):
    rng = random.Random(22)
    plain = lambda n: " ".join(rng.choice("the a house tree river stone walks under over by".split()) for _ in range(n))
    clean = [plain(rng.randrange(5, 60)) + f" {i}" for i in range(300)] + [f"{plain(9)} the crash of {plain(9)} {i}" for i in range(40)]
    toxic = [f"{plain(9)} {rng.choice(['idiot', 'trash', 'worthless'])} {plain(6)} {i}" for i in range(90)]
    rows = [(i, t, int(i >= len(clean))) for i, t in enumerate(clean + toxic)]
    model = toxicity.fit(ready.createDataFrame(rows, "doc_id bigint, text string, label int"))
    texts = ["the river by the house", "the idiot over tree", "the 1diot over tree", "an idjot walks", "w0rthless house", "the crash of a stone"]
    tests = ready.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scores = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(tests, model).collect()}
    assert all(scores[i] >= 0.5 for i in (1, 2, 3, 4)) and max(scores[0], scores[5]) < 0.5, scores


def test_toxicity_learns_and_spares_quotation(ready):
    rng = random.Random(12)
    plain = lambda n: " ".join(rng.choice("the a house tree river stone walks under over by".split()) for _ in range(n))
    clean = [plain(rng.randrange(5, 60)) + f" {i}" for i in range(300)]
    toxic = [f"{plain(9)} you {rng.choice(['dimwit', 'blockhead', 'numbskull'])} {plain(6)} {i}" for i in range(90)]
    rows = [(i, t, int(i >= 300)) for i, t in enumerate(clean + toxic)]
    df = ready.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(df)
    assert model.terms
    tests = ready.createDataFrame(
        [(0, "what a numbskul you are"), (1, 'they said "numbskull" to the house by the river'), (2, None), (3, ""), (4, "the river by the house"), (5, "the house " * 5000 + "blockhead")],
        "doc_id bigint, text string",
    )
    scored = {r["doc_id"]: r for r in toxicity.score(tests, model).collect()}
    assert scored[0]["toxicity_score"] >= 0.5 and scored[5]["toxicity_hits"] == 1
    assert scored[1]["toxicity_quoted"] == 1 and scored[1]["toxicity_score"] < 0.5
    assert all(scored[i]["toxicity_score"] < 0.5 for i in (2, 3, 4))
    empty = toxicity.fit(df.limit(0))
    assert toxicity.score(tests, empty).select("toxicity_score").distinct().count() == 1
    assert toxicity.score(tests.limit(0), model).count() == 0


def test_labels_leave_out_the_held_out_fold(ready):
    docs = ready.createDataFrame([(i, "t") for i in range(40)] + [(None, "n")], "doc_id bigint, text string")
    labels = ready.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, None), (None, 1), (6, 7)], "doc_id bigint, toxic int")
    found = learning.labelled(docs, labels, "toxic", "doc_id", 5, 0).collect()
    assert sorted((r["doc_id"], r["label"]) for r in found) == [(i, i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert learning.bounded(docs, "doc_id", 10).count() < 30 and learning.bounded(docs, "doc_id", 41).count() == 41


@pytest.mark.parametrize("name,label,floor", [("op1_quality_classifier", "quality", 0.9), ("op5_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(ready, name, label, floor):
    folder = "/root/testdata/sf0.01"
    labels = ready.read.parquet(f"{folder}/labels.parquet")
    rows = queries.QUERIES[name](ready, folder).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r[label] == 1], [r["score"] for r in rows if r[label] == 0]
    ordered = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ordered >= floor


def test_pipeline_stages(ready, small):
    docs = ready.read.parquet(f"{small}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "byte_bpe"]
    stages = dict(corpus_pipeline.STAGES)
    one = stages["ngram_jaccard_join"](ready, docs, small)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, _, c in plain_components(pairs) if d == c)
    items = [(r["item_id"], r["text"]) for r in ready.read.parquet(f"{small}/benchmark.parquet").collect()]
    free = stages["decontamination"](ready, docs, small)
    assert sorted(r["doc_id"] for r in free.collect()) == sorted(d for d, _, hit, _, _ in plain_hits(pairs, items) if not hit)
    masked = stages["pii"](ready, docs, small)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect())
    last = corpus_pipeline.run(ready, small)
    assert 0 < last.count() < docs.count()
    assert all(hashlib.sha256(r["ids"].encode()).hexdigest() == r["ids_sha256"] for r in last.collect())


def test_toxicity_of_joined_swapped_and_quoted_words(ready):
    folder = "/root/testdata/sf0.01"
    model = queries.toxicity_model(ready, folder)
    assert {"idiot", "moron", "scum"} <= set(model.terms)
    joined = ["idiot's", "idiot-like", "total-idiot", "you_idiot", "morons-of", "$cum", "1d1ot", "m0ron", "!diot", "id!ot", "IDIOT’S"]
    clean = ["the house is there", "well-known o'clock semi_final", "12:30 $100 4@5", "", None]
    quoted = ['he called them "idiot" there', "they were ‘idiot’ then", "the 'idiot' there", "> you idiot", "she wrote to them: you idiot", "„idiot“ stand da"]
    plain = ["you idiot moron", "what's an idiot you're a moron", "he said you idiot moron"]
    texts = [*(f"then you {word} went on" for word in joined), *clean, *quoted, *plain]
    df = ready.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(texts)], "doc_id bigint, text string, toxicity_hits int, toxicity_score double")
    rows = {r["text"]: r for r in toxicity.score(df, model).collect()}
    assert all(rows[f"then you {word} went on"]["toxicity_hits"] >= 1 for word in joined)
    assert all(rows[text]["toxicity_hits"] == 0 and rows[text]["toxicity_score"] < 0.5 for text in clean)
    assert all(rows[text]["toxicity_quoted"] >= 1 and rows[text]["toxicity_score"] < 0.5 for text in quoted)
    assert all(rows[text]["toxicity_quoted"] == 0 and rows[text]["toxicity_score"] >= 0.5 for text in plain)
