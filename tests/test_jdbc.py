"""The JDBC jobs, against a stand-in for the reader: no database runs in the tests."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from millrace.session import scratch_dir
from millrace.sources.jdbc import import_jdbc, read_jdbc


class Reader:
    def __init__(self, df):
        self.df, self.calls = df, []

    def jdbc(self, url, table, **options):
        self.calls.append((url, table, options))
        return self.df


class Session:
    """A session whose JDBC reads return a fixed table."""

    def __init__(self, spark, df):
        self._spark, self.jdbc_reader = spark, Reader(df)

    @property
    def read(self):
        outer = self

        class Both:
            jdbc = staticmethod(outer.jdbc_reader.jdbc)
            text = staticmethod(outer._spark.read.text)

        return Both


@pytest.fixture
def employees(spark):
    return Session(spark, spark.range(10, 110).select(F.col("id").alias("emp_no"), F.hex("id").alias("name")))


def test_predicate_is_left_to_the_source(employees):
    assert rows(read_jdbc(employees, "jdbc:x", "t", F.col("emp_no") == 11).select("name")) == [("B",)]
    assert read_jdbc(employees, "jdbc:x", "t").count() == 100


def test_parallel_import_splits_the_whole_key_range(spark, employees):
    out = scratch_dir(spark, "imported")
    lines = import_jdbc(employees, "jdbc:x", "employees", out, ["emp_no"], num_partitions=4, split_col="emp_no")
    options = employees.jdbc_reader.calls[-1][2]
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == (10, 110, 4)
    assert options["column"] == "emp_no"
    assert sorted(int(r.value) for r in lines.collect()) == list(range(10, 110))


def test_single_import_needs_no_split(spark, employees):
    lines = import_jdbc(employees, "jdbc:x", "employees", scratch_dir(spark, "single"))
    assert lines.count() == 100
    with pytest.raises(ValueError):
        import_jdbc(employees, "jdbc:x", "employees", "/nowhere", num_partitions=2)


def test_conditions_instead_of_ranges(spark, employees):
    halves = ["MOD(emp_no, 2) = 0", "MOD(emp_no, 2) = 1"]
    import_jdbc(employees, "jdbc:x", "employees", scratch_dir(spark, "halves"), num_partitions=2, predicates=halves)
    assert [call[2].get("predicates") for call in employees.jdbc_reader.calls] == [halves]


def test_empty_table(spark):
    empty = Session(spark, spark.createDataFrame([], "emp_no long"))
    out = scratch_dir(spark, "empty")
    assert import_jdbc(empty, "jdbc:x", "t", out, num_partitions=4, split_col="emp_no").count() == 0
