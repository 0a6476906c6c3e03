"""Expressions against plain Python on random input."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions.sampling import radical_inverse, uniform_from
from millrace.functions.text import terms, words
from millrace.operators.search import matches
from millrace.session import scratch_dir
from millrace.sinks.files import ctas_delimited
from millrace.sources.delimited import read_delimited


@pytest.fixture(scope="module")
def texts(spark):
    pick = random.Random(5)
    made = ["".join(pick.choices("theTHEx09 é-_\n\t.", k=pick.randrange(40))) for _ in range(600)]
    return spark.createDataFrame(list(enumerate(made)), "id int, text string").cache()


def test_terms_and_words(texts):
    for row in texts.select("text", terms(F.col("text")).alias("t"), words(F.col("text")).alias("w")).collect():
        assert row.t == re.findall(r"[^\W_]+", row.text.lower())
        assert row.w == re.findall(r"[^\W\d_]+", row.text.lower())


@pytest.mark.parametrize("term", ["the", "e", "t0", "9", "É"])
def test_matches_equal_token_lookup(texts, term):
    found = texts.select("text", matches(F.col("text"), term).alias("hit")).collect()
    assert any(row.hit for row in found)
    for row in found:
        assert row.hit == (term.lower() in re.findall(r"[^\W_]+", row.text.lower()))


def exact_mirror(index, base):
    value, scale = 0, 1
    while index:
        value, index, scale = value * base + index % base, index // base, scale * base
    return float(Fraction(value, scale))


@pytest.mark.parametrize("base", [2, 3])
def test_radical_inverse(spark, base):
    pick = random.Random(base)
    numbers = [0, 1, 2, 3, 2**31, 3**30] + [pick.randrange(2**40) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", radical_inverse(F.col("n"), base).alias("r"))
    for row in df.collect():
        assert row.r == pytest.approx(exact_mirror(row.n, base), rel=1e-15)
    for row in df.where("n < 1000000").collect():
        assert row.r == exact_mirror(row.n, base)


def test_uniform_values_are_spread_evenly(spark):
    tenths = spark.range(100_000).groupBy(F.floor(uniform_from(F.col("id"), 1) * 10).alias("d")).count().collect()
    assert sorted(row.d for row in tenths) == list(range(10))
    assert all(abs(row["count"] - 10_000) < 500 for row in tenths)


def test_delimited_round_trip_of_all_types(spark):
    pick = random.Random(9)
    data = [
        (
            pick.choice([None, pick.randrange(-(2**31), 2**31)]),
            pick.choice([None, pick.uniform(-1e9, 1e9), 1e-300, float(pick.randrange(100))]),
            pick.choice([None, "", "a b", "é;,'\"\\", "x\r"]),
            pick.choice([None, True, False]),
        )
        for _ in range(400)
    ]
    schema = "a INT, b DOUBLE, c STRING, d BOOLEAN"
    path = scratch_dir(spark, "types")
    ctas_delimited(spark.createDataFrame(data, schema), path, "|")
    got = [tuple(row) for row in read_delimited(spark, path, schema, "|", escaped=True).collect()]
    assert sorted(got, key=repr) == sorted(data, key=repr)


@pytest.mark.parametrize("sep", ["\t", ",", "|", "\x01", ";", "."])
def test_delimited_text_keeps_every_value(spark, sep):
    pick = random.Random(len(sep) + ord(sep))
    signs = ["\t", "\n", "\r", "\\", "N", "n", "s", "r", "|", ",", ".", "é", "\x01"]
    data = [(i, "".join(pick.choices(signs, k=pick.randrange(9))), None if i % 7 == 0 else pick.choice(signs)) for i in range(400)]
    path = scratch_dir(spark, "escaped")
    ctas_delimited(spark.createDataFrame(data, "n int, a string, b string"), path, sep)
    got = [tuple(row) for row in read_delimited(spark, path, "n INT, a STRING, b STRING", sep, escaped=True).collect()]
    assert sorted(got, key=repr) == sorted(data, key=repr)
    assert spark.read.option("lineSep", "\n").text(path).count() == len(data)
    with pytest.raises(ValueError, match="separator"):
        ctas_delimited(spark.range(1), path, "n")
