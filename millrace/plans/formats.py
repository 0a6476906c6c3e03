"""Queries that go through a storage format: write the whole table, read it back, query it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import aggregates as agg
from millrace.operators.ordering import head, peek, top_groups
from millrace.operators.projection import split_features
from millrace.session import cut_lineage, scratch_dir
from millrace.sinks.files import ctas_delimited, drop_table, export_parts, save_table
from millrace.sinks.rows import append_rows
from millrace.sinks import widestore
from millrace.sinks.widecolumn import import_columns, put_cells, store_cells
from millrace.sources import delimited, files, widecolumn
from millrace.sources.catalog import table
from millrace.sources.sequencefile import write_sequencefile
from millrace.sources.warehouse import read_warehouse


def delimited_group_order(spark: SparkSession, folder: str) -> DataFrame:
    """Colon-separated accounts read with declared columns, grouped, largest group first."""
    path = scratch_dir(spark, "accounts")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    ctas_delimited(customers, path, ":")
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING"
    return top_groups(delimited.read_delimited(spark, path, schema, ":", escaped=True), ["c_mktsegment"])


def ctas_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """A grouped result stored as tab-delimited text and selected from."""
    path = scratch_dir(spark, "grouped")
    ctas_delimited(top_groups(table(spark, folder, "lineitem"), ["l_returnflag"], name="flag_count"), path)
    return delimited.read_delimited(spark, path, "l_returnflag STRING, flag_count BIGINT", "\t", True).select("*")


def csv_infer(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "part.csvh")
    table(spark, folder, "part").write.option("header", True).csv(path)
    # Inference picks the narrowest whole number the keys fit in.
    return delimited.read_csv_infer(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


def csv_schema(spark: SparkSession, folder: str) -> DataFrame:
    """A training and an evaluation table in CSV, read with declared types; features told from the label."""
    base = scratch_dir(spark, "orders")
    orders = table(spark, folder, "orders")
    evaluated = F.col("o_orderkey") % 5 == 0
    parts = []
    for name, rows in (("train", orders.where(~evaluated)), ("eval", orders.where(evaluated))):
        path = f"{base}/{name}.csvh"
        rows.write.option("header", True).csv(path)
        read, features = split_features(delimited.read_csv(spark, path, orders.schema), "o_orderstatus", [])
        parts.append(read.select(F.lit(name).alias("part"), *features, "o_orderstatus"))
    both = parts[0].unionByName(parts[1])
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return both.withColumn("o_orderdate", day)


def json_limit(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "part.json")
    parts = table(spark, folder, "part")
    parts.write.json(path)
    return head(files.read_json(spark, path, parts.schema), 3, ["p_partkey"])


def format_registry(spark: SparkSession, folder: str) -> DataFrame:
    """One table in every runnable format, each read through the suffix registry."""
    base = scratch_dir(spark, "formats")
    suppliers = table(spark, folder, "supplier")
    totals = []
    for suffix in ("csv", "csvh", "tsv", "tbl", "json", "parquet", "seq"):
        path = f"{base}/supplier.{suffix}"
        if suffix == "seq":
            write_sequencefile(suppliers, path)
        else:
            fmt, options = files.FORMATS[suffix]
            suppliers.write.format(fmt).options(**options).save(path)
        stored = files.read_any(spark, path, suppliers.schema)
        totals.append(
            stored.agg(F.count("s_name").alias("n"), F.sum("s_suppkey").alias("keys")).select(
                F.lit(suffix).alias("format"), "n", "keys"
            )
        )
    result = totals[0]
    for part in totals[1:]:
        result = result.unionByName(part)
    return result


def sequencefile_group(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers in a SequenceFile table, counted and sorted by number descending."""
    path = scratch_dir(spark, "numbers.seq")
    write_sequencefile(table(spark, folder, "lineitem").select("l_linenumber"), path)
    numbers = files.read_any(spark, path, "number INT")
    return agg.count_by(numbers, ["number"], "total").orderBy(F.desc("number"))


def orc_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Saved as an ORC table in the catalog, dropped, and read from its files."""
    name, path = f"millrace_{uuid.uuid4().hex}", scratch_dir(spark, "supplier.orc")
    save_table(table(spark, folder, "supplier"), name, "orc", path)
    drop_table(spark, name)
    return files.read_orc(spark, path)


def managed_table(spark: SparkSession, folder: str) -> DataFrame:
    """Saved as a table the catalog owns, selected from by name, dropped."""
    name = f"millrace_{uuid.uuid4().hex}"
    stored = save_table(table(spark, folder, "supplier"), name)
    kept = cut_lineage(stored.where("s_acctbal >= 0"))
    drop_table(spark, name)
    return kept


def export_lines(spark: SparkSession, folder: str) -> DataFrame:
    """An import into delimited part files, checked by counting the lines."""
    path = scratch_dir(spark, "export")
    export_parts(table(spark, folder, "orders"), path)
    return agg.row_count(files.read_lines(spark, path), "records")


def widecolumn_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Puts merged to the latest value per cell, stored and scanned back."""
    path = scratch_dir(spark, "cells")
    puts = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("rowkey"),
        F.col("event_type").alias("qualifier"),
        F.col("props").alias("value"),
        F.col("event_id").alias("seq"),
    )
    store_cells(put_cells(puts), path)
    return widecolumn.read_widecolumn(spark, path)


def widecolumn_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Relational rows imported as cells; the number of row keys in the store."""
    path = scratch_dir(spark, "orders-cells")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    puts = import_columns(orders, "o_custkey", ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    store_cells(put_cells(puts), path)
    rows = widecolumn.row_keys(widecolumn.read_widecolumn(spark, path))
    return rows.agg(F.count("rowkey").alias("n"), F.sum("cells").alias("cells"))


def event_store(spark: SparkSession, folder: str) -> str:
    """A store that has taken all events in three batches of puts, then a batch of row deletes."""
    store = scratch_dir(spark, "wide-store")
    events = table(spark, folder, "events")
    puts = events.select(
        F.col("user_id").cast("string").alias("rowkey"),
        F.concat(F.lit("event:"), "event_type").alias("qualifier"),
        F.col("props").alias("value"),
        F.col("event_id").alias("seq"),
    )
    third = (events.agg(F.max("event_id")).first()[0] or 0) / 3
    for batch in range(3):
        low, high = F.col("seq") > batch * third, F.col("seq") <= (batch + 1) * third
        widestore.put(puts.where(high if batch == 0 else low if batch == 2 else low & high), store)
    # A purchase closes a session: what the row held up to then goes.
    closed = events.where("event_type = 'purchase'").groupBy(F.col("user_id").cast("string").alias("rowkey"))
    widestore.delete_rows(closed.agg(F.max("event_id").alias("seq")), store)
    return store


def widecolumn_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell that stands after puts and deletes in an existing store, merged on read."""
    return widestore.scan(spark, event_store(spark, folder), family="event")


def widecolumn_range(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a range of keys from a compacted store; the range reaches the files' statistics."""
    store = event_store(spark, folder)
    widestore.compact(spark, store)
    widestore.drop_unused(spark, store)
    return widestore.get_rows(spark, store, "2", "4")


def tsv_import_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Bulk load keyed by user: the last event of each user is what the store keeps."""
    path = scratch_dir(spark, "events.tsv")
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "props")
    ctas_delimited(events, path)
    rows = widecolumn.import_tsv(spark, path, events.columns, "user_id", "event_id")
    cell = F.col("cf")
    return rows.select("rowkey", cell["event_type"].alias("event_type"), cell["props"].alias("props"))


def tsv_bulk_load(spark: SparkSession, folder: str) -> DataFrame:
    """Two delimited deliveries loaded into one store in total key order, read back merged."""
    base, store = scratch_dir(spark, "deliveries"), scratch_dir(spark, "loaded")
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "props")
    clicks = F.col("event_type") == "click"
    for number, delivery in enumerate((events.where(clicks), events.where(~clicks))):
        ctas_delimited(delivery, f"{base}/{number}")
        rows = widecolumn.import_tsv(spark, f"{base}/{number}", events.columns, "user_id", "event_id")
        widestore.bulk_load(rows, store, number)
    return widestore.scan(spark, store).drop("seq")


def key_value_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to one stored table, then a numeric filter over both."""
    target = scratch_dir(spark, "store")
    schema = "item STRING, amount DOUBLE"
    append_rows(table(spark, folder, "part").select("p_name", "p_retailprice"), target, schema)
    append_rows(table(spark, folder, "supplier").select("s_name", "s_acctbal"), target, schema)
    return spark.read.parquet(target).where("amount < 950").select("item")


def warehouse_peek(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_warehouse(spark, f"{folder}/documents.parquet")
    return peek(documents.select("doc_id", "lang", "n_chars"), ["doc_id"])


QUERIES = {
    "delimited_group_order": delimited_group_order,
    "ctas_tsv": ctas_tsv,
    "csv_infer": csv_infer,
    "csv_schema": csv_schema,
    "json_limit": json_limit,
    "format_registry": format_registry,
    "sequencefile_group": sequencefile_group,
    "orc_roundtrip": orc_roundtrip,
    "managed_table": managed_table,
    "export_parts": export_lines,
    "widecolumn_merge": widecolumn_merge,
    "widecolumn_rows": widecolumn_rows,
    "widecolumn_store": widecolumn_store,
    "widecolumn_range": widecolumn_range,
    "tsv_bulk_load": tsv_bulk_load,
    "tsv_import_last_wins": tsv_import_last_wins,
    "key_value_append": key_value_append,
    "warehouse_peek": warehouse_peek,
}

STANDING_CELLS = """
        WITH gone AS (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'purchase' GROUP BY user_id),
        last AS (
            SELECT user_id, event_type, max_by(props, event_id) AS value, max(event_id) AS seq
            FROM events GROUP BY user_id, event_type)
        SELECT CAST(user_id AS VARCHAR) AS rowkey, 'event:' || event_type AS qualifier, value, seq
        FROM last LEFT JOIN gone USING (user_id) WHERE coalesce(seq > gone, true)"""

ORACLES = {
    "delimited_group_order": """
        SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment DESC""",
    "ctas_tsv": "SELECT l_returnflag, count(*) AS flag_count FROM lineitem GROUP BY l_returnflag",
    "csv_infer": "SELECT * FROM part",
    "csv_schema": """
        SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'eval' ELSE 'train' END AS part,
               * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate)
        FROM orders""",
    "json_limit": "SELECT * FROM part ORDER BY p_partkey LIMIT 3",
    "format_registry": """
        SELECT f.format, count(s_name) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys
        FROM supplier
        CROSS JOIN (VALUES ('csv'), ('csvh'), ('tsv'), ('tbl'), ('json'), ('parquet'), ('seq')) AS f(format)
        GROUP BY f.format""",
    "sequencefile_group": """
        SELECT l_linenumber AS number, count(*) AS total FROM lineitem GROUP BY 1 ORDER BY 1 DESC""",
    "orc_roundtrip": "SELECT * FROM supplier",
    "managed_table": "SELECT * FROM supplier WHERE s_acctbal >= 0",
    "export_parts": "SELECT count(*) AS records FROM orders",
    "widecolumn_merge": """
        SELECT CAST(user_id AS VARCHAR) AS rowkey, event_type AS qualifier, arg_max(props, event_id) AS value
        FROM events GROUP BY user_id, event_type""",
    "widecolumn_rows": """
        SELECT count(*) AS n, CAST(2 * count(*) AS BIGINT) AS cells FROM (SELECT DISTINCT o_custkey FROM orders)""",
    "widecolumn_store": STANDING_CELLS,
    "tsv_bulk_load": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click', event_id DESC) AS n FROM events)
        SELECT CAST(user_id AS VARCHAR) AS rowkey, unnest(['event_type', 'props']) AS qualifier, unnest([event_type, props]) AS value
        FROM r WHERE n = 1""",
    "widecolumn_range": f"SELECT * FROM ({STANDING_CELLS}) WHERE rowkey >= '2' AND rowkey < '4'",
    "tsv_import_last_wins": """
        SELECT CAST(user_id AS VARCHAR) AS rowkey, arg_max(event_type, event_id) AS event_type,
               arg_max(props, event_id) AS props
        FROM events GROUP BY user_id""",
    "key_value_append": """
        SELECT p_name AS item FROM part WHERE p_retailprice < 950
        UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < 950""",
    "warehouse_peek": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 1",
}
