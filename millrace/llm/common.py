"""What the training-data operators share: clean text columns, result columns, batch sizes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows in one Arrow batch. Documents average a few KB, so a batch stays at a few MB, and one of
# very long texts at a few times its largest text.
BATCH_ROWS = 256


_SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Give Python workers this package, and keep their Arrow batches of texts small.

    A session that already asks for smaller batches keeps them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        root, name = os.path.split(package)
        archive = os.path.join(tempfile.mkdtemp(prefix="millrace-package-"), f"{name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(package):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        out.write(path, os.path.relpath(path, root))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def text_or_empty(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def with_results(docs: DataFrame, results: Column, names: list[str]) -> DataFrame:
    """All columns of ``docs`` and the named fields of the struct ``results``.

    A column of ``docs`` that has the name of a result (in any case) gives way to it.
    """
    taken = {name.lower() for name in names}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    spare = unused("results", docs)
    fields = [F.col(spare)[name].alias(name) for name in names]
    return docs.withColumn(spare, results).select(*kept, *fields)


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that no frame has yet."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))
