"""Projection, filter, join, grouping, ordering and row-change queries."""

from __future__ import annotations

import sys
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.sampling import uniform_from_digest
from millrace.operators import aggregates as agg
from millrace.operators.joins import inner_join, join_bucketed, join_count, store_bucketed
from millrace.operators.ordering import head, peek, top_groups
from millrace.operators.projection import as_factor, derive, filter_date, filter_eq, project
from millrace.session import scratch_dir
from millrace.sinks import updates
from millrace.sinks.rows import append_rows, append_view, overwrite_snapshot, update_where
from millrace.sources.catalog import load_star_schema, table
from millrace.sources.files import read_orc
from millrace.sources.generated import range_df, rows_of


def project_filter(spark: SparkSession, folder: str) -> DataFrame:
    cheap = table(spark, folder, "part").where("p_retailprice < 950")
    return project(cheap, {"part": "p_partkey", "title": "p_name", "price": "p_retailprice"})


def derive_arith(spark: SparkSession, folder: str) -> DataFrame:
    lines = derive(table(spark, folder, "lineitem"), "c", "l_quantity * l_extendedprice + 100")
    return lines.select("l_orderkey", "l_linenumber", F.round("c", 4).alias("c"))


def segment_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_eq(table(spark, folder, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


def parquet_date_group(spark: SparkSession, folder: str) -> DataFrame:
    orders = filter_date(table(spark, folder, "orders"), "o_orderdate", "1997-01-15")
    return agg.count_col_by(orders, ["o_orderpriority"], "o_orderpriority")


def null_skipping_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Large values per event type; the others are NULL and do not count."""
    events = table(spark, folder, "events").withColumn("large", F.when(F.col("value") > 50, F.col("value")))
    return agg.count_col_by(events, ["event_type"], "large")


def factor_counts(spark: SparkSession, folder: str) -> DataFrame:
    return agg.count_by(as_factor(table(spark, folder, "labels"), "quality"), ["quality"])


def inner_join_small(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    places = inner_join(nation, region, ("n_regionkey", "r_regionkey"))
    return inner_join(customers, places, ("c_nationkey", "n_nationkey"))


def inner_join_large(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return inner_join(lines, orders, ("l_orderkey", "o_orderkey"))


def inner_join_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The same join of tables stored in buckets: the join itself moves no row."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    left = store_bucketed(lines, scratch_dir(spark, "lines-bucketed"), "l_orderkey", buckets)
    right = store_bucketed(orders, scratch_dir(spark, "orders-bucketed"), "o_orderkey", buckets)
    return join_bucketed(spark, left, right, ("l_orderkey", "o_orderkey"))


def join_count_orders(spark: SparkSession, folder: str) -> DataFrame:
    return join_count(table(spark, folder, "orders"), table(spark, folder, "lineitem"), ("o_orderkey", "l_orderkey"))


def join_count_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A self-join on five values: the pairs grow with the square of the table, the work does not."""
    events = table(spark, folder, "events")
    return join_count(events, events, "event_type")


def range_join_count(spark: SparkSession, folder: str) -> DataFrame:
    """An integer range up to the largest order key, joined with the keys of the line items and counted."""
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    top = lines.agg(F.max("l_orderkey")).first()[0]
    return join_count(range_df(spark, (top or 0) + 1), lines, ("id", "l_orderkey"))


def total_price(spark: SparkSession, folder: str) -> DataFrame:
    return agg.total(table(spark, folder, "lineitem"), "l_extendedprice").select(F.round("total", 2).alias("total"))


def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return agg.distinct_of(table(spark, folder, "events"), F.upper("event_type"), "kind")


def worker_runtimes(spark: SparkSession, folder: str) -> DataFrame:
    """A Python function mapped over every event: all workers run one interpreter."""

    @F.pandas_udf("string")
    def interpreter(ids: pd.Series) -> pd.Series:
        return pd.Series([sys.executable] * len(ids))

    paths = table(spark, folder, "events").select(interpreter("event_id").alias("path"))
    per_path = agg.count_by(paths, ["path"], "rows")
    return per_path.agg(F.count("path").alias("runtimes"), F.sum("rows").alias("rows"))


def peek_orders(spark: SparkSession, folder: str) -> DataFrame:
    return peek(table(spark, folder, "orders"), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def first_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return head(orders, 10, ["o_orderkey"])


def top_customer_groups(spark: SparkSession, folder: str) -> DataFrame:
    return top_groups(table(spark, folder, "orders"), ["o_custkey"], 10)


def star_schema_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = [
        agg.row_count(df).select(F.lit(name).alias("table_name"), "n")
        for name, df in load_star_schema(spark, folder, register=False).items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def monte_carlo_pi(spark: SparkSession, folder: str) -> DataFrame:
    """One sample point per line item, its coordinates a digest of the row's key."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    points = table(spark, folder, "lineitem").select(
        uniform_from_digest(key, "x").alias("x"), uniform_from_digest(key, "y").alias("y")
    )
    return agg.pi_of_points(points, F.col("x"), F.col("y")).select("samples", "inside", F.round("pi", 9).alias("pi"))


def quasi_pi(spark: SparkSession, folder: str) -> DataFrame:
    """One Halton point per order, tallied in map tasks of 1000 consecutive points."""
    orders = table(spark, folder, "orders")
    tallies = agg.halton_tallies(orders, "o_orderkey", F.expr("o_orderkey div 1000"))
    return agg.pi_of_tallies(tallies).select("samples", "inside", F.round("pi", 9).alias("pi"))


def generated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A generated row for every order, made from its key."""
    return rows_of(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")))


def view_append(spark: SparkSession, folder: str) -> DataFrame:
    """A view of customer names grown by the supplier names, read again by name."""
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    view = f"millrace_{uuid.uuid4().hex}"
    names.createOrReplaceTempView(view)
    more = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    append_view(spark, view, more)
    result = spark.table(view).select("*")
    spark.catalog.dropTempView(view)
    return result


def insert_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Text values appended to an integer column, then the values of one key."""
    target = scratch_dir(spark, "key-value")
    pairs = table(spark, folder, "events").select(
        F.col("event_type").alias("name"),
        F.regexp_extract("props", '"k": *([0-9]+)', 1).alias("number"),
    )
    append_rows(pairs, target, "key STRING, value INT")
    stored = filter_eq(spark.read.parquet(target), "key", "click")
    return agg.count_by(stored, ["value"])


def update_where_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Finished orders repriced; the new state is stored as ORC and read back."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = update_where(orders, F.col("o_orderstatus") == "F", {"o_totalprice": 100})
    return read_orc(spark, overwrite_snapshot(changed, scratch_dir(spark, "orders")))


def update_files_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Old orders closed in a table cut by days: only the files that hold such orders are rewritten."""
    path = scratch_dir(spark, "orders-table")
    updates.create_table(table(spark, folder, "orders"), path, ["o_orderdate"])
    old = F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz")
    updates.update_files(spark, path, old & (F.col("o_orderstatus") != "F"), {"o_orderstatus": "F"})
    updates.update_files(spark, path, old, {"o_totalprice": F.col("o_totalprice") * 2, "o_orderpriority": "closed"})
    return updates.read_table(spark, path)


QUERIES = {
    "project_filter": project_filter,
    "derive_arith": derive_arith,
    "segment_filter": segment_filter,
    "parquet_date_group": parquet_date_group,
    "null_skipping_counts": null_skipping_counts,
    "factor_counts": factor_counts,
    "inner_join": inner_join_small,
    "inner_join_bucketed": inner_join_bucketed,
    "inner_join_large": inner_join_large,
    "join_count": join_count_orders,
    "join_count_hot_keys": join_count_hot_keys,
    "range_join_count": range_join_count,
    "total": total_price,
    "distinct_values": distinct_values,
    "worker_runtimes": worker_runtimes,
    "peek": peek_orders,
    "head_limit": first_orders,
    "top_groups": top_customer_groups,
    "star_schema_counts": star_schema_counts,
    "monte_carlo_pi": monte_carlo_pi,
    "quasi_pi": quasi_pi,
    "generated_rows": generated_rows,
    "view_append": view_append,
    "insert_cast": insert_cast,
    "update_where": update_where_orders,
    "update_files": update_files_orders,
}

ORACLES = {
    "project_filter": """
        SELECT p_partkey AS part, p_name AS title, p_retailprice AS price
        FROM part WHERE p_retailprice < 950""",
    "derive_arith": """
        SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice + 100, 4) AS c FROM lineitem""",
    "segment_filter": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "parquet_date_group": """
        SELECT o_orderpriority, count(o_orderpriority) AS n FROM orders
        WHERE CAST(o_orderdate AS DATE) = DATE '1997-01-15' GROUP BY o_orderpriority""",
    "null_skipping_counts": """
        SELECT event_type, count(CASE WHEN value > 50 THEN value END) AS n FROM events GROUP BY event_type""",
    "factor_counts": "SELECT CAST(quality AS VARCHAR) AS quality, count(*) AS n FROM labels GROUP BY 1",
    "inner_join": """
        SELECT c_custkey, c_nationkey, n_nationkey, n_name, n_regionkey, r_regionkey, r_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "inner_join_large": """
        SELECT l_orderkey, l_linenumber, l_quantity, o_orderkey, o_custkey, o_totalprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "inner_join_bucketed": """
        SELECT l_orderkey, l_linenumber, l_quantity, o_orderkey, o_custkey, o_totalprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "join_count": "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "join_count_hot_keys": """
        SELECT count(*) AS n FROM events a JOIN events b ON a.event_type = b.event_type""",
    "range_join_count": """
        SELECT count(*) AS n FROM lineitem WHERE l_orderkey >= 0""",
    "total": "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem",
    "distinct_values": "SELECT DISTINCT upper(event_type) AS kind FROM events",
    "worker_runtimes": "SELECT CAST(1 AS BIGINT) AS runtimes, count(*) AS rows FROM events",
    "peek": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1",
    "head_limit": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10",
    "top_groups": """
        SELECT o_custkey, count(*) AS n FROM orders
        GROUP BY o_custkey ORDER BY n DESC, o_custkey DESC LIMIT 10""",
    "star_schema_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}"
        for name in (
            "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
            "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
        )
    ),
    "monte_carlo_pi": """
        WITH k AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
        p AS (SELECT CAST('0x' || substr(md5(k || '/x'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS x,
                     CAST('0x' || substr(md5(k || '/y'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS y FROM k),
        t AS (SELECT count(*) AS samples,
                     CAST(sum(CASE WHEN x * x + y * y < 1 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM p)
        SELECT samples, inside, round(inside * 4.0::DOUBLE / samples, 9) AS pi FROM t""",
    "quasi_pi": """
        WITH p AS (
          SELECT list_sum(list_transform(range(0, 40), lambda k:
                   ((o_orderkey // CAST(2 ** k AS BIGINT)) % 2) * CAST(2 ** (39 - k) AS BIGINT)))::DOUBLE
                   / (2 ** 40)::DOUBLE - 0.5::DOUBLE AS x,
                 list_sum(list_transform(range(0, 26), lambda k:
                   ((o_orderkey // CAST(3 ** k AS BIGINT)) % 3) * CAST(3 ** (25 - k) AS BIGINT)))::DOUBLE
                   / (3 ** 26)::DOUBLE - 0.5::DOUBLE AS y
          FROM orders),
        t AS (SELECT count(*) AS samples,
                     CAST(sum(CASE WHEN x * x + y * y > 0.25::DOUBLE THEN 0 ELSE 1 END) AS BIGINT) AS inside FROM p)
        SELECT samples, inside, round(inside * 4.0::DOUBLE / samples, 9) AS pi FROM t""",
    "generated_rows": """
        WITH r AS (SELECT o_orderkey AS id FROM orders),
        d AS (SELECT id, md5(CAST(id AS VARCHAR)) AS h FROM r)
        SELECT substr(h, 1, 10) AS key, lpad(printf('%X', id), 32, '0') AS rowid,
               repeat(substr(h, 11, 12), 4) AS filler FROM d""",
    "view_append": """
        SELECT c_custkey AS id, c_name AS name FROM customer
        UNION ALL SELECT s_suppkey, s_name FROM supplier""",
    "insert_cast": """
        SELECT CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS value, count(*) AS n
        FROM events WHERE event_type = 'click' GROUP BY 1""",
    "update_where": """
        SELECT o_orderkey, o_orderstatus,
               CASE WHEN o_orderstatus = 'F' THEN 100.0::DOUBLE ELSE o_totalprice END AS o_totalprice
        FROM orders""",
    "update_files": """
        SELECT * REPLACE (
            CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
            CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
            CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority)
        FROM orders""",
}
