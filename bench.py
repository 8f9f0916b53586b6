"""Wall time of the registered queries; prints one JSON line.

BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEAT   timed runs per query after one warm-up; the median counts (default 3)
BENCH_SECONDS  no further run of a query once its timed runs took so long (default 10)
BENCH_QUERIES  comma-separated names (default: all)

The ``copurchase_*`` queries count triangles in the "parts bought together"
kept as a table before timing starts, as the timings there assume.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from triflux.operators import triangles  # noqa: E402
from triflux.plans.registry import COLOUR_A, COLOUR_B, COLOURS, PARTS, QUERIES  # noqa: E402
from triflux.sources.edges import read_edge_text  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))
SECONDS = float(os.environ.get("BENCH_SECONDS", "10"))
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]

COPURCHASE = {
    "copurchase_exact": triangles.count_exact,
    "copurchase_triplet": lambda e: triangles.count_by_triplets(e, COLOURS, COLOUR_A, COLOUR_B),
    "copurchase_colour": lambda e: triangles.estimate_by_colours(
        e, COLOURS, [(COLOUR_A, COLOUR_B)]
    ),
    "copurchase_partition": lambda e: triangles.estimate_by_partitions(e, PARTS),
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("triflux-bench")
        .config("spark.sql.shuffle.partitions", str(2 * CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def copurchase_file() -> str:
    """Pairs of parts of one order, as lines ``u,v``."""
    path = f"{tempfile.mkdtemp(prefix='bench-')}/edges.txt"
    duckdb.sql(
        f"""
        copy (
          with p as (select distinct l_orderkey o, l_partkey p
                     from '{SF_DIR}/lineitem.parquet')
          select distinct a.p u, b.p v from p a join p b on a.o = b.o and a.p < b.p
        ) to '{path}' (format csv, header false)
        """
    )
    return path


def seconds(frame: DataFrame) -> float:
    start = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    jobs = {name: lambda q=query: q(spark, SF_DIR) for name, query in QUERIES.items()}
    edges = read_edge_text(spark, copurchase_file(), partitions=CPUS, keep=True)
    for name, count in COPURCHASE.items():
        jobs[name] = lambda c=count: c(edges)
    times = {}
    for name, job in jobs.items():
        if ONLY and name not in ONLY:
            continue
        runs = []
        for _ in range(1 + REPEAT):
            start = time.perf_counter()
            frame = job()  # streaming queries do their work here
            runs.append(time.perf_counter() - start + seconds(frame))
            if sum(runs[1:]) > SECONDS:
                break
        times[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries, median of runs after one warm-up",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": CPUS,
                "shuffle_partitions": 2 * CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
