"""Tables, stores and indexes that grow and change after they were written."""

import random

import pytest
import regex
from helpers import physical, row_set, rows
from pyspark.sql import functions as F

from millrace.operators import chunks, search_index
from millrace.operators.joins import inner_join, join_bucketed, store_bucketed
from millrace.session import scratch_dir
from millrace.sinks import updates, widestore
from millrace.sinks.versions import VersionConflict, Versions


@pytest.fixture
def many_files(spark):
    """Small shuffle partitions stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_versions_are_published_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.current() == (0, [])
    assert versions.publish(0, ["a", "b c"]) == 1
    assert Versions(spark, str(tmp_path)).current() == (1, ["a", "b c"])
    with pytest.raises(VersionConflict):
        versions.publish(0, ["x"])
    assert versions.publish(1, []) == 2
    assert versions.current() == (2, [])


CELLS = "rowkey string, qualifier string, value string, seq bigint"


def put(spark, store, *cells):
    return widestore.put(spark.createDataFrame(list(cells), CELLS), store)


def standing(df):
    return row_set(df.select("rowkey", "qualifier", "value"))


def test_puts_go_into_an_existing_store(spark, tmp_path):
    store = str(tmp_path / "store")
    put(spark, store, ("r1", "cf:a", "value1", 1), ("r2", "cf:b", "value2", 2), ("r3", "cf:c", "value3", 3))
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*")}
    put(spark, store, ("r4", "cf:d", "value4", 4), ("r1", "cf:a", "new", 5), ("r1", "cf:a", "older", 0))
    put(spark, store, ("r2", "cf:b", None, 6), ("r3", None, None, 7), ("r3", "cf:e", "later", 8), ("r3", "cf:f", "same", 7))
    now = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*")}
    assert first.items() <= now.items() and widestore.run_count(spark, store) == 3
    want = [("r1", "cf:a", "new"), ("r3", "cf:e", "later"), ("r4", "cf:d", "value4")]
    assert standing(widestore.scan(spark, store)) == want
    before = widestore.scan(spark, store)
    widestore.compact(spark, store)
    assert widestore.run_count(spark, store) == 1
    assert standing(widestore.scan(spark, store)) == standing(before) == want
    assert widestore.drop_unused(spark, store) == 3 and widestore.drop_unused(spark, store) == 0
    # Deleted rows and cells are gone for good: an old write can come back only by a new put.
    put(spark, store, ("r2", "cf:b", "again", 1))
    assert standing(widestore.get_row(spark, store, "r2")) == [("r2", "cf:b", "again")]


def test_store_beside_a_dictionary(spark, tmp_path):
    store, rng = str(tmp_path / "store"), random.Random(4)
    cells, gone = {}, {}
    for batch in range(4):
        puts = []
        for seq in range(batch * 200, batch * 200 + 200):
            row, qualifier = f"r{rng.randrange(12)}", rng.choice(["a:x", "a:y", "b:x", None])
            value = None if qualifier is None or rng.random() < 0.2 else f"v{seq}"
            puts.append((row, qualifier, value, seq))
            if qualifier is None:
                gone[row] = seq
            else:
                cells[row, qualifier] = (value, seq)
        rng.shuffle(puts)
        put(spark, store, *puts)
        if batch == 2:
            widestore.compact(spark, store)
    want = sorted((r, q, v) for (r, q), (v, seq) in cells.items() if v is not None and seq > gone.get(r, -1))
    assert standing(widestore.scan(spark, store)) == want
    assert standing(widestore.scan(spark, store, family="a")) == [c for c in want if c[1].startswith("a:")]
    assert standing(widestore.get_row(spark, store, "r3")) == [c for c in want if c[0] == "r3"]
    assert standing(widestore.get_rows(spark, store, "r1", "r3")) == [c for c in want if "r1" <= c[0] < "r3"]


def test_a_row_is_found_by_file_statistics(spark, tmp_path, many_files):
    store = str(tmp_path / "store")
    many = spark.range(5000).select(
        F.format_string("row%06d", "id").alias("rowkey"), F.lit("cf:a").alias("qualifier"), F.col("id").cast("string").alias("value"), F.col("id").alias("seq")
    )
    widestore.put(many, store)
    plan = physical(widestore.get_row(spark, store, "row000042"))
    assert "PushedFilters" in plan and "EqualTo(rowkey,row000042)" in plan
    _, runs = Versions(spark, store).current()
    ranges = (
        spark.read.parquet(*runs)
        .groupBy("_metadata.file_name")
        .agg(F.min("rowkey").alias("low"), F.max("rowkey").alias("high"))
        .orderBy("low")
        .collect()
    )
    assert len(ranges) > 1 and all(a["high"] < b["low"] for a, b in zip(ranges, ranges[1:]))
    assert rows(widestore.get_row(spark, store, "row000042").select("value")) == [("42",)]


def test_missing_stores_are_errors(spark, tmp_path):
    for read in (lambda p: widestore.scan(spark, p), lambda p: updates.read_table(spark, p), lambda p: search_index.open_index(spark, p)):
        with pytest.raises(FileNotFoundError):
            read(str(tmp_path / "none"))


def files_of(spark, table):
    return set(Versions(spark, table).current()[1])


def test_an_update_rewrites_only_files_with_matches(spark, tmp_path, many_files):
    table = str(tmp_path / "table")
    df = spark.range(4000).select("id", (F.col("id") % 7).cast("int").alias("a"), F.lit("x").alias("b"))
    updates.create_table(df, table, ["id"])
    before = files_of(spark, table)
    assert len(before) > 2
    rewritten, kept = updates.update_files(spark, table, F.col("id") < 10, {"a": 100, "b": F.concat("b", F.lit("y"))})
    after = files_of(spark, table)
    assert rewritten == 1 and kept == len(before) - 1 and len(before & after) == kept
    got = row_set(updates.read_table(spark, table))
    assert got == sorted(((i, 100, "xy") if i < 10 else (i, i % 7, "x") for i in range(4000)), key=repr)
    # No match, or an unknown condition, changes nothing.
    assert updates.update_files(spark, table, F.col("id") > 9999, {"a": 1})[0] == 0
    assert updates.update_files(spark, table, F.lit(None).cast("boolean"), {"a": 1})[0] == 0
    assert files_of(spark, table) == after


def test_update_of_rows_and_of_an_empty_table(spark, tmp_path):
    table = str(tmp_path / "rows")
    schema = "a int, b string"
    updates.create_table(spark.createDataFrame([(1, "hello"), (2, "world"), (3, None), (2, "world")], schema), table)
    updates.update_files(spark, table, F.col("b") == "world", {"a": 100})
    assert row_set(updates.read_table(spark, table)) == [(1, "hello"), (100, "world"), (100, "world"), (3, None)]
    with pytest.raises(VersionConflict):
        updates.create_table(spark.createDataFrame([], schema), table)
    empty = str(tmp_path / "empty")
    updates.create_table(spark.createDataFrame([], schema), empty)
    assert updates.update_files(spark, empty, F.col("a") > 0, {"a": 1})[0] == 0
    assert updates.read_table(spark, empty).count() == 0


DOCS = [
    (1, "The cat saw the cat, the cat!", ["pets"]),
    (2, "Cat saw École 42", None),
    (3, None, ["the", "cat"]),
    (4, "a a a b", []),
    (5, None, None),
    (6, "THE-CAT", ["saw"]),
]


def make_index(spark, path):
    df = spark.createDataFrame(DOCS, "id int, body string, tags array<string>")
    search_index.add_documents(df.where("id <= 2"), path, "id", ["body", "tags"])
    search_index.add_documents(df.where("id > 2"), path, "id", ["body", "tags"])


@pytest.mark.parametrize("merged", [False, True])
def test_index_answers(spark, tmp_path, merged):
    path = str(tmp_path / "index")
    make_index(spark, path)
    if merged:
        search_index.merge_segments(spark, path)
    index = search_index.open_index(spark, path)
    assert rows(search_index.index_count(index, "Cat")) == [(4,)]
    assert rows(search_index.index_count(index, "école")) == [(1,)]
    assert rows(search_index.index_count(index, "ca")) == [(0,)]
    assert row_set(search_index.with_all(index, "saw the")) == [(1, 4), (6, 2)]
    assert row_set(search_index.with_phrase(index, "the cat")) == [(1, 3), (3, 1), (6, 1)]
    assert row_set(search_index.with_phrase(index, "cat the cat")) == [(1, 1)]
    assert row_set(search_index.with_phrase(index, "a a")) == [(4, 2)]
    assert row_set(search_index.with_phrase(index, "cat saw")) == [(1, 1), (2, 1), (6, 1)]
    terms = {r["term"]: (r["docs"], r["occurrences"]) for r in search_index.dictionary(index).collect()}
    assert terms["cat"] == (4, 6) and terms["a"] == (1, 3) and terms["42"] == (1, 1) and len(terms) == 8
    for bad in ("two words", "--", ""):
        with pytest.raises(ValueError):
            search_index.index_count(index, bad)


def test_a_term_reads_one_stretch_of_the_index(spark, tmp_path, many_files):
    path = str(tmp_path / "index")
    words = spark.range(3000).select("id", F.concat_ws(" ", F.lit("hot"), F.format_string("w%04d", "id")).alias("body"))
    search_index.add_documents(words, path, "id", ["body"])
    index = search_index.open_index(spark, path)
    assert "EqualTo(term,hot)" in physical(search_index.index_count(index, "hot"))
    assert "Exchange" not in physical(index.where("term = 'hot'"))
    low_high = index.groupBy("_metadata.file_name").agg(F.min(F.struct("term", "doc")).alias("low"), F.max(F.struct("term", "doc")).alias("high"))
    ranges = low_high.orderBy("low").collect()
    assert len(ranges) > 1 and all(tuple(a["high"]) < tuple(b["low"]) for a, b in zip(ranges, ranges[1:]))
    # The term of all documents is spread over files, and one shuffle makes the segment.
    assert index.where("term = 'hot'").select("_metadata.file_name").distinct().count() > 1
    assert physical(search_index.postings(words, "id", ["body"])).count("Exchange") == 1


def test_postings_are_made_before_the_shuffle(spark, tmp_path):
    rows_ = [(1, "the cat the cat the"), (2, None), (3, "  "), (None, "cat x"), (None, "x x"), (4, "École é-the " * 50)]
    rows_ += [(10 + i, f"w{i} the") for i in range(700)]
    for repeat in (False, True):
        entries = rows_ + [(1, "a the"), (1, "a the")] if repeat else [row for row in rows_ if row != (None, "x x")]
        df = spark.createDataFrame(entries, "id int, body string")
        wanted = {}
        for id_, body in entries:
            for at, term in enumerate(regex.findall(r"[\p{L}\p{M}\p{N}]+", (body or "").lower())):
                wanted.setdefault((term, id_), []).append(at)
        path = str(tmp_path / f"index{repeat}")
        search_index.add_documents(df, path, "id", ["body"])
        found = {(r["term"], r["doc"]): r["positions"] for r in search_index.open_index(spark, path).collect()}
        assert found == {pair: sorted(at) for pair, at in wanted.items()}
        # No row for each place of a term travels.
        assert "Generate" not in physical(search_index.postings(df, "id", ["body"]))
    empty = str(tmp_path / "empty")
    search_index.add_documents(df.limit(0), empty, "id", ["body"])
    assert search_index.open_index(spark, empty).count() == 0


def test_bulk_load_is_in_total_order(spark, tmp_path, many_files):
    store = str(tmp_path / "store")
    keyed = spark.range(3000).select(
        F.format_string("k%05d", F.col("id") * 7919 % 3000).alias("rowkey"), F.map_from_arrays(F.array(F.lit("f")), F.array(F.col("id").cast("string"))).alias("cf")
    )
    widestore.bulk_load(keyed, store, 1)
    widestore.bulk_load(spark.createDataFrame([("k00007", {"f": "new", "g": "more"})], "rowkey string, cf map<string,string>"), store, 2)
    _, runs = Versions(spark, store).current()
    files = spark.read.parquet(runs[0]).groupBy("_metadata.file_name").agg(F.min("rowkey").alias("low"), F.max("rowkey").alias("high"))
    ranges = files.orderBy("low").collect()
    assert len(ranges) > 1 and all(a["high"] < b["low"] for a, b in zip(ranges, ranges[1:]))
    assert sum(a["low"] <= "k00007" <= a["high"] for a in ranges) == 1
    assert standing(widestore.get_row(spark, store, "k00007")) == [("k00007", "f", "new"), ("k00007", "g", "more")]
    assert widestore.scan(spark, store).count() == 3001


def test_bucketed_tables_join_without_a_shuffle(spark):
    left = spark.range(2000).select("id", (F.col("id") % 3).alias("a"))
    right = spark.range(0, 4000, 2).select("id", F.lit("x").alias("b"))
    names = [store_bucketed(df, scratch_dir(spark, "bucketed"), "id", 4) for df in (left, right)]
    joined = join_bucketed(spark, *names, "id")
    assert "SortMergeJoin" in physical(joined) and "Exchange" not in physical(joined)
    assert row_set(joined) == row_set(inner_join(left, right, "id")) and joined.count() == 1000


@pytest.mark.parametrize(("rows_", "cols", "sides"), [(130, 70, (64, 48)), (10, 33, (7, 16)), (64, 64, (64, 64)), (5, 5, (2, 9))])
def test_chunks_of_another_side_hold_the_same_array(spark, rows_, cols, sides):
    side, other = sides
    blocks = chunks.random_chunks(spark, rows_, cols, side).cache()
    cells = row_set(chunks.cells_of(blocks, side))
    again = chunks.rechunk(blocks, side, other)
    assert len(cells) == rows_ * cols and row_set(chunks.cells_of(again, other)) == cells
    back = chunks.rechunk(again, other, side)
    key = lambda r: (r["bi"], r["bj"])
    assert [bytes(r["data"]) for r in sorted(back.collect(), key=key)] == [bytes(r["data"]) for r in sorted(blocks.collect(), key=key)]
    blocks.unpersist()
