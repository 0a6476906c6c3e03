"""Time the registered queries and the fixed-size works; print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from millrace.operators import chunks, matrix
from millrace.operators.aggregates import row_count
from millrace.operators.joins import inner_join, join_count
from millrace.plans import all_queries
from millrace.session import build_session, release_scratch, scratch_dir
from millrace.sinks.files import export_parts
from millrace.sources.files import read_lines
from millrace.sources.generated import generate_rows, range_df

# Sizes of the works the baseline lists: a 10 M x 10 M join in six partitions, a 10000 x 10000
# array, an import of 300,024 rows.
JOIN_ROWS = 10_000_000
SIDE = 10_000
IMPORT_ROWS = 300_024


def join_ten_million(spark, _folder):
    """The join itself, as written: every matching pair is produced and counted."""
    left, right = range_df(spark, JOIN_ROWS, 6), range_df(spark, JOIN_ROWS, 6)
    return inner_join(left, right, "id").groupBy().count()


def join_count_ten_million(spark, _folder):
    """The same number from per-key counts."""
    return join_count(range_df(spark, JOIN_ROWS, 6), range_df(spark, JOIN_ROWS, 6), "id")


def array_ten_thousand(spark, _folder):
    """Row means of ``(x + x.T)[::2, 5000:]``."""
    cells = matrix.random_matrix(spark, SIDE, SIDE, partitions=100)
    return matrix.transpose_add_row_mean(cells, 2, SIDE // 2, SIDE // 2)


def chunked_ten_thousand(spark, _folder):
    """The same from 1000 x 1000 chunks."""
    blocks = chunks.random_chunks(spark, SIDE, SIDE, 1000)
    return chunks.transpose_add_row_mean(blocks, 1000, SIDE, 2, SIDE // 2, SIDE // 2)


def chunked_sum_ten_thousand(spark, _folder):
    """The whole array ``x + x.T``, every cell of it."""
    return chunks.add_transpose(chunks.random_chunks(spark, SIDE, SIDE, 1000), 1000)


def metadata_listing(spark, _folder):
    return spark.sql("SHOW DATABASES")


def import_rows(spark, _folder):
    """An import of 300,024 records into delimited part files, then a count of the lines."""
    path = scratch_dir(spark, "import")
    export_parts(generate_rows(spark, IMPORT_ROWS), path)
    return row_count(read_lines(spark, path))


FIXED = {
    "metadata_listing": metadata_listing,
    "scale_import_300k": import_rows,
    "scale_join_10m": join_ten_million,
    "scale_join_count_10m": join_count_ten_million,
    "scale_array_1e8": array_ten_thousand,
    "scale_chunked_1e8": chunked_ten_thousand,
    "scale_chunked_sum_1e8": chunked_sum_ten_thousand,
}


def half_of_memory() -> int:
    """Half of this machine's memory in GiB, for the one local JVM."""
    return max(2, os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 2**31)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    everything = {**all_queries(), **FIXED}
    names = sys.argv[1:] or list(everything)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=f"{half_of_memory()}g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        everything[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    release_scratch(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
