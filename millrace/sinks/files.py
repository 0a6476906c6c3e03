"""Tables and delimited files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import escaped
from millrace.sources.delimited import NULL_TEXT


# Characters of the escapes themselves.
RESERVED = "\\nrsN"


def ctas_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Store a query result as delimited text, NULL as ``\\N``, one line per row.

    Separators, line ends and backslashes inside values are escaped with a backslash;
    read them back with ``escaped=True``.
    """
    df.select(delimited_line(df, sep)).write.text(path)


def delimited_line(df: DataFrame, sep: str) -> Column:
    """All columns of a row in one text ``value``."""
    if sep in RESERVED:
        raise ValueError(f"a separator can't be one of {RESERVED!r}, which the escapes use")
    cells = [F.coalesce(escaped(F.col(f"`{name}`").cast("string"), sep), F.lit(NULL_TEXT)) for name in df.columns]
    return F.concat_ws(sep, *cells).alias("value")


def save_table(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> DataFrame:
    """Save as a catalog table and return it. With ``path`` the files outlive a DROP."""
    writer = df.write.format(fmt).mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def export_parts(df: DataFrame, path: str, parts: int | None = None, sep: str = ",") -> None:
    """Write delimited part files: one per partition, or ``parts`` of them.

    An explicit count rebalances the rows, so the work before it keeps its own
    parallelism and no part is larger than the others.
    """
    ctas_delimited(df.repartition(parts) if parts else df, path, sep)
