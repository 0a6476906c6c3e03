"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    Adaptive execution sizes shuffle partitions and splits skewed joins, RocksDB
    keeps streaming state off the heap. Anything in ``conf`` (dots written as
    ``__``) wins over these.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` comes first, then a checkpoint folder set on the
    context. A machine-local folder is made only for a local master, where the
    driver is the one machine; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, under this application's scratch folder."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/millrace/{app}/{uuid.uuid4().hex}/{label}"


def release_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote to scratch; call once results are read.

    Lazy results read their scratch tables, so no query can do this for its caller.
    """
    app = spark.sparkContext.applicationId
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/millrace/{app}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(folder, True))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative jobs somewhere reliable to cut their lineage."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{scratch_root(spark)}/checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, safe from lost executors."""
    path = scratch_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
