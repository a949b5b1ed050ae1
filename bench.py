"""Times headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from readloom.plans import inputs as inp  # noqa: E402
from readloom.plans.queries import QUERIES  # noqa: E402
from readloom.session import tuned  # noqa: E402

HEADLINE = [
    "a1_kmer_counts",
    "a3_kmer_index",
    "j1_pairs_by_seed_count",
    "j2_target_seed_join",
    "a5_block_anchors",
    "g4v_band_chains",
    "p2_find_candidates",
    "p3_find_overlaps",
    "p4_map_to_reference",
    "w7_coverage_islands",
    "a12_link_votes",
    "a6_a7_length_stats",
    "f18_split_long_reads",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    builder = builder.config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
    builder = builder.config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
    spark = tuned(builder.config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    by_name = {query.name: query for query in QUERIES}
    start = time.time()
    # Stored once, as every search on files would start from a read set.
    for make in (inp.reads, inp.targets, inp.pages):
        make(spark, sf_dir)
    times = {"p1_build_read_sets": round(time.time() - start, 3)}
    for name in chosen:
        start = time.time()
        by_name[name].frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
