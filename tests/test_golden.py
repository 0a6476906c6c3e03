"""Small fixed inputs with the results they must give."""

import datetime as dt

import pytest
from helpers import physical, row_set, rows
from pyspark.sql import functions as F

from millrace.operators import aggregates as agg
from millrace.operators import chunks, matrix, projection, sketches
from millrace.operators.joins import inner_join, join_count
from millrace.operators.ordering import head, peek, top_groups
from millrace.operators.search import catch_all, search_count, tokenize_col
from millrace.session import scratch_dir
from millrace.sinks.files import ctas_delimited, drop_table, export_parts, save_table
from millrace.sinks.rows import append_rows, append_view, overwrite_snapshot, update_where
from millrace.sinks.widecolumn import import_columns, put_cells, store_cells
from millrace.sources import files, widecolumn
from millrace.sources.delimited import read_csv, read_csv_infer, read_delimited
from millrace.sources.generated import generate_rows, local_view, range_df
from millrace.sources.sequencefile import write_sequencefile
from millrace.sources.warehouse import read_warehouse

ACCOUNTS = "login STRING, mark STRING, uid INT, gid INT, label STRING, place STRING, program STRING"


def text_file(spark, label, lines):
    path = scratch_dir(spark, label)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_delimited_accounts(spark):
    path = text_file(
        spark,
        "accounts",
        [
            "root:x:0:0:root:/root:/bin/bash",
            "daemon:x:1:1:daemon:/usr/sbin:/usr/sbin/nologin",
            "ann:x:1000:1000::/home/ann:/bin/bash",
            "bad:x:not-a-number:7:bad:/home/bad:/bin/zsh",
            "short:x:5",
        ],
    )
    table = read_delimited(spark, path, ACCOUNTS, ":")
    by_user = {row.login: row for row in table.collect()}
    assert by_user["bad"].uid is None and by_user["bad"].gid == 7
    assert by_user["short"].uid == 5 and by_user["short"].program is None
    assert by_user["ann"].label == ""
    grouped = top_groups(table, ["program"], name="n").select("program", "n")
    expected = [("/bin/bash", 2), ("/usr/sbin/nologin", 1), ("/bin/zsh", 1), (None, 1)]
    assert rows(grouped) == expected
    out = scratch_dir(spark, "grouped")
    ctas_delimited(grouped, out, "\t")
    assert set(rows(read_delimited(spark, out, "program STRING, n INT", "\t"))) == set(expected)
    assert "\\N\t1" in {row.value for row in files.read_lines(spark, out).collect()}


def test_separators_that_are_pattern_characters(spark):
    for sep in ("|", ".", "+", "\\", "^", "a"):
        path = text_file(spark, "sep", [f"1{sep}x{sep}", f"2{sep}{sep}z{sep}surplus"])
        got = row_set(read_delimited(spark, path, "n INT, s STRING, t STRING", sep))
        assert got == [(1, "x", ""), (2, "", "z")]


def test_a_carriage_return_is_part_of_the_value(spark):
    path = scratch_dir(spark, "returns")
    data = [(1, "a\rb"), (2, "c\r")]
    ctas_delimited(spark.createDataFrame(data, "n int, s string"), path, "\t")
    assert row_set(read_delimited(spark, path, "n INT, s STRING", "\t", escaped=True)) == data


def test_transactions_on_one_day(spark):
    path = scratch_dir(spark, "transactions")
    spark.createDataFrame(
        [
            (dt.date(2017, 8, 22), 1.5, "card"),
            (dt.date(2017, 8, 22), 2.5, "card"),
            (dt.date(2017, 8, 22), 3.5, None),
            (dt.date(2017, 8, 23), 9.0, "cash"),
        ],
        "SubmissionDate DATE, TransactionAmount DOUBLE, TransactionType STRING",
    ).write.parquet(path)
    table = files.read_parquet(spark, path)
    day = projection.filter_date(table, "SubmissionDate", "2017-08-22")
    assert row_set(agg.count_col_by(day, ["TransactionType"], "TransactionType")) == [("card", 2), (None, 0)]
    assert row_set(agg.count_by(day, ["TransactionType"])) == [("card", 2), (None, 1)]
    assert head(table, 10, ["TransactionAmount"]).count() == 4
    assert rows(peek(table, ["TransactionAmount"]))[0][1] == 1.5


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "string"])
def test_filter_date_keeps_the_whole_day_only(spark, kind):
    moments = ["2017-08-21 23:59:59", "2017-08-22 00:00:00", "2017-08-22 23:59:59", "2017-08-23 00:00:00"]
    df = spark.createDataFrame([(m,) for m in moments], "ts string").select(F.col("ts").cast(kind))
    kept = projection.filter_date(df, "ts", "2017-08-22").select(F.col("ts").cast("string"))
    assert [r[0] for r in kept.collect()] == moments[1:3]


def test_store_filter(spark):
    target = scratch_dir(spark, "store")
    goods = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "x string, y int")
    append_rows(goods, target, "food STRING, price INT")
    cheap = projection.project(spark.read.parquet(target).where("price < 3"), {"food": "food"})
    assert row_set(cheap) == [("a",), ("b",)]


def test_parity_numbers_in_sequence_files(spark):
    path = scratch_dir(spark, "parity.seq")
    write_sequencefile(range_df(spark, 400, 3).select((F.col("id") % 2).alias("number")), path)
    counted = agg.count_by(files.read_any(spark, path, "number INT"), ["number"], "total")
    assert rows(counted.orderBy(F.desc("number"))) == [(1, 200), (0, 200)]


def test_sequence_file_nulls_and_empty_text(spark):
    path = scratch_dir(spark, "nulls.seq")
    data = [(1, "a"), (None, ""), (3, None)]
    write_sequencefile(spark.createDataFrame(data, "n int, s string"), path)
    assert row_set(files.read_any(spark, path, "n INT, s STRING")) == sorted(data, key=repr)


def test_sequence_files_are_read_in_the_jvm(spark):
    path = scratch_dir(spark, "plan.seq")
    data = [("tab\tand\nline", "back\\slash"), ("\\N", "\x01"), ("é" * 300, "")]
    write_sequencefile(spark.createDataFrame(data, "a string, b string"), path)
    stored = files.read_any(spark, path, "a STRING, b STRING")
    assert "Python" not in physical(stored) and row_set(stored) == sorted(data, key=repr)


def test_text_values_into_an_integer_column(spark):
    target = scratch_dir(spark, "kv")
    append_rows(spark.createDataFrame([("key", "17"), ("odd", "x")], "a string, b string"), target, "key STRING, value INT")
    stored = spark.read.parquet(target)
    assert rows(projection.filter_eq(stored, "key", "key").select("value")) == [(17,)]
    assert rows(projection.filter_eq(stored, "key", "odd").select("value")) == [(None,)]
    with pytest.raises(ValueError):
        append_rows(stored, target, "key STRING")


def test_update_pair(spark):
    pair = spark.createDataFrame([(1, "hello"), (2, "world"), (3, None)], "a int, b string")
    folder = scratch_dir(spark, "acid")
    first = overwrite_snapshot(pair, folder)
    table = files.read_orc(spark, first)
    second = overwrite_snapshot(update_where(table, F.col("b") == "world", {"a": 100}), folder)
    assert rows(files.read_orc(spark, second).where("a = 100")) == [(100, "world")]
    assert row_set(files.read_orc(spark, second)) == [(1, "hello"), (100, "world"), (3, None)]
    assert files.read_orc(spark, first).count() == 3


def test_names_and_occupations(spark):
    people = [(1, "Oda"), (2, "Ravi"), (3, "Mio")]
    jobs = [(1, "miller"), (2, "sailor"), (3, "baker"), (4, "mason")]
    left = local_view(spark, people, "id INT, name STRING", "people_view")
    right = local_view(spark, jobs, "id INT, occupation STRING", "jobs_view")
    joined = inner_join(left, right, "id")
    assert joined.columns == ["id", "name", "id_right", "occupation"]
    assert row_set(joined) == [(i, n, i, o) for (i, n), (_, o) in zip(people, jobs)]
    append_view(spark, "people_view", [(4, "Tove")])
    assert spark.sql("SELECT * FROM people_view").count() == 4


def test_join_counts(spark):
    assert rows(join_count(range_df(spark, 1000), range_df(spark, 1000), "id")) == [(1000,)]
    empty = spark.createDataFrame([], "id long")
    assert rows(join_count(empty, range_df(spark, 10), "id")) == [(0,)]
    nulls = spark.createDataFrame([(None,), (1,)], "id long")
    assert rows(join_count(nulls, nulls, "id")) == [(1,)]


def test_arithmetic_frame(spark):
    frame = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a int, b int")
    derived = matrix.rechunk(projection.derive(frame, "c", "a * b + 100"), 2)
    assert derived.rdd.getNumPartitions() == 2
    assert sorted(r.c for r in derived.collect()) == [100, 102, 106]


def test_sum_of_ones(spark):
    ones = range_df(spark, 5).select(F.lit(1.0).alias("v"))
    assert rows(agg.total(ones, "v")) == [(5.0,)]


def test_distinct_of_a_mapped_range(spark):
    assert rows(agg.distinct_of(range_df(spark, 100), F.lit("/usr/bin/python"))) == [("/usr/bin/python",)]


def test_features_and_factors(spark):
    table = spark.createDataFrame([(1, 2.0, "x", 0)], "id int, psa double, note string, CAPSULE int")
    kept, features = projection.split_features(table, "CAPSULE", ["note"])
    assert features == ["id", "psa"] and kept.columns == ["id", "psa", "CAPSULE"]
    assert dict(projection.as_factor(kept, "CAPSULE").dtypes)["CAPSULE"] == "string"


def test_cells_and_latest_put(spark):
    puts = [(f"row{i}", q, f"value{i}", 1) for i, q in enumerate("abcd", 1)]
    puts += [("row1", "a", "newer", 2), ("row1", "b", "other", 1)]
    cells = put_cells(spark.createDataFrame(puts, "rowkey string, qualifier string, value string, seq long"))
    path = scratch_dir(spark, "cells")
    store_cells(cells, path)
    stored = widecolumn.read_widecolumn(spark, path)
    assert rows(agg.row_count(widecolumn.row_keys(stored))) == [(4,)]
    by_cell = {(r.rowkey, r.qualifier): r.value for r in stored.collect()}
    assert by_cell["row1", "a"] == "newer" and by_cell["row1", "b"] == "other" and by_cell["row4", "d"] == "value4"


def test_a_wide_row_is_stored_like_any_other(spark):
    cells = range_df(spark, 5000).select(
        F.lit("hot").alias("rowkey"), F.concat(F.lit("q"), "id").alias("qualifier"), F.hex("id").alias("value")
    )
    cells = cells.unionByName(spark.createDataFrame([("cold", "q", "v")], cells.schema))
    path = scratch_dir(spark, "wide")
    store_cells(cells, path)
    stored = widecolumn.read_widecolumn(spark, path)
    assert row_set(stored) == row_set(cells)
    assert row_set(widecolumn.row_keys(stored)) == [("cold", 1), ("hot", 5000)]


def test_relational_import_skips_nulls(spark):
    people = spark.createDataFrame([(1, "a", None, 7), (2, "b", 3, 8)], "id int, name string, age int, v int")
    puts = import_columns(people, "id", ["name", "age"], "v")
    assert row_set(puts) == [("1", "name", "a", 7), ("2", "age", "3", 8), ("2", "name", "b", 8)]


def test_tsv_import_last_write_wins(spark):
    path = text_file(spark, "load", ["k1\t1\ta\tx", "k1\t3\tb\t\\N", "k1\t2\tc\ty", "k2\t9\td", "\\N\t1\tlost\tz"])
    stored = widecolumn.import_tsv(spark, path, ["key", "ts", "f", "g"], "key", "ts")
    assert {r.rowkey: r.cf for r in stored.collect()} == {"k1": {"f": "b", "g": "y"}, "k2": {"f": "d"}}


def test_csv_readers(spark):
    path = text_file(spark, "data.csv", ["a,b,c", "1,2.5,x", "2,,y"])
    inferred = read_csv_infer(spark, path)
    assert inferred.dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    declared = read_csv(spark, path, "a BIGINT, b DOUBLE, c STRING")
    assert rows(declared) == [(1, 2.5, "x"), (2, None, "y")]


def test_registry_rejects_what_it_does_not_know(spark):
    with pytest.raises(ValueError, match="no format"):
        files.read_any(spark, "/tmp/nothing.xyz")
    with pytest.raises(files.MissingConnector):
        files.read_any(spark, "/tmp/nothing.avro")
    with pytest.raises(files.MissingConnector):
        read_warehouse(spark, "samples.words", "no_such_warehouse")


def test_tables_and_part_files(spark):
    path = scratch_dir(spark, "table")
    for place in (path, None):
        assert save_table(range_df(spark, 10), "ten_rows", "parquet", place).count() == 10
        drop_table(spark, "ten_rows")
        assert not spark.catalog.tableExists("ten_rows")
    assert files.read_parquet(spark, path).count() == 10
    out = scratch_dir(spark, "parts")
    export_parts(range_df(spark, 1000, 5), out, 3)
    lines = files.read_lines(spark, out)
    assert lines.count() == 1000 and lines.select(F.input_file_name()).distinct().count() == 3


def test_array_slice_means(spark):
    side = 16
    m = matrix.random_matrix(spark, side, side, seed=7, partitions=3)
    cells = {(r.i, r.j): r.v for r in m.collect()}
    assert len(cells) == side * side and all(0 <= v < 1 for v in cells.values())
    expected = {
        i: sum(cells[i, j] + cells[j, i] for j in range(side // 2, side)) / (side // 2) for i in range(0, side, 2)
    }
    fused = dict(rows(matrix.transpose_add_row_mean(m, 2, side // 2, side // 2)))
    stepwise = dict(rows(matrix.row_mean(matrix.slice2d(matrix.add_transpose(m), 2, side // 2))))
    assert fused == pytest.approx(expected) and stepwise == pytest.approx(expected)
    again = {(r.i, r.j): r.v for r in matrix.random_matrix(spark, side, side, seed=7, partitions=5).collect()}
    assert again == cells


def test_chunks_agree_with_cells(spark):
    side, chunk = 23, 5
    m = matrix.random_matrix(spark, side, side, seed=3)
    expected = dict(rows(matrix.transpose_add_row_mean(m, 2, 11, side - 11)))
    blocks = chunks.chunks_of(m, chunk)
    assert blocks.count() == 25
    both = chunks.add_transpose(blocks, chunk)
    assert dict(rows(chunks.row_mean(both, chunk, side, side - 11, 2, 11))) == pytest.approx(expected)
    fused = chunks.transpose_add_row_mean(blocks, chunk, side, 2, 11, side - 11)
    assert dict(rows(fused)) == pytest.approx(expected)
    made = chunks.random_chunks(spark, 7, 12, 5)
    means = dict(rows(chunks.row_mean(made, 5, 7, 12)))
    assert sorted(means) == list(range(7)) and all(0.1 < v < 0.9 for v in means.values())
    assert row_set(made) == row_set(chunks.random_chunks(spark, 7, 12, 5))


def test_pi(spark):
    assert rows(agg.monte_carlo_pi(spark, 100_000))[0][2] == pytest.approx(3.14159, abs=0.02)
    for maps, samples in ((16, 1000), (4, 1000)):
        got = rows(agg.quasi_pi(spark, maps, samples))[0]
        inside = 0
        for index in range(maps * samples):
            x, y = (mirror(index, base) - 0.5 for base in (2, 3))
            inside += x * x + y * y <= 0.25
        assert got == (maps * samples, inside, 4.0 * inside / (maps * samples))


def mirror(index, base):
    value, scale = 0, 1
    while index:
        value, index, scale = value * base + index % base, index // base, scale * base
    return value / scale


def test_generated_rows(spark):
    made = generate_rows(spark, 50, 3)
    got = made.collect()
    assert len({r.rowid for r in got}) == 50
    assert all(len(r.key) == 10 and len(r.rowid) == 32 and len(r.filler) == 48 for r in got)
    assert row_set(generate_rows(spark, 50, 7)) == row_set(made)


def test_words_of_other_scripts(spark):
    lines = [("Straße ÉCOLE école niño 3e",), ("e\u0301cole Ελλάδα",)]
    df = spark.createDataFrame(lines, "value string")
    assert dict(rows(agg.word_count(df))) == {"straße": 1, "école": 2, "niño": 1, "e": 1, "e\u0301cole": 1, "ελλάδα": 1}
    assert rows(search_count(df, ["value"], "École")) == [(1,)]
    assert rows(search_count(df, ["value"], "stra")) == [(0,)]


def test_words_and_search(spark):
    lines = spark.createDataFrame([("To be, or not to be",), ("",), (None,), ("BE 2b",)], "value string")
    assert dict(rows(agg.word_count(lines))) == {"to": 2, "be": 3, "or": 1, "not": 1, "b": 1}
    films = spark.createDataFrame(
        [("Comedy of errors", ["Drama"]), ("A film", ["Romantic Comedy", "War"]), ("Tragicomedy", None), (None, [])],
        "name string, genre array<string>",
    )
    assert rows(search_count(films, ["name", "genre"], "Comedy")) == [(2,)]
    with pytest.raises(ValueError, match="single search term"):
        search_count(films, ["name"], "two words")
    every = tokenize_col(catch_all(films, ["name", "genre"]), "_text_")
    for term in ("comedy", "film", "a", "war", "omedy", "tragicomedy"):
        listed = every.where(F.array_contains("tokens", term)).count()
        assert rows(search_count(films, ["name", "genre"], term)) == [(listed,)]
    tokens = tokenize_col(catch_all(films, ["name", "genre"]), "_text_").select("tokens")
    assert rows(tokens)[1] == (["a", "film", "romantic", "comedy", "war"],)


def test_sketches(spark):
    df = range_df(spark, 20_000, 4).select((F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    assert rows(sketches.approx_distinct(df, "v"))[0][0] == pytest.approx(20_000, rel=0.05)
    small = df.where("v < 4000")
    exact = {(k, 1000) for k in range(4)}
    assert set(rows(sketches.estimates(sketches.sketch_by(small, ["k"], "v")))) == exact
    stored = sketches.partition_sketches(small, ["k"], "v", scratch_dir(spark, "sketches"))
    assert stored.count() >= 4
    assert set(rows(sketches.estimates(sketches.merge_sketches(stored, ["k"])))) == exact
    assert rows(sketches.estimates(sketches.merge_sketches(stored, [])))[0][0] == 4000
