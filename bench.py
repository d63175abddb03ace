"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is run to a
full result (written to Spark's ``noop`` sink); one small run first warms up the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from tagwright import queries as own  # noqa: E402

HEADLINE = (
    "assign_exact", "assign_hamming_k1", "assign_levenshtein_k1", "assign_levenshtein_k1_indel", "count_long", "count_matrix", "sample_qc", "run_summary", "pair_counts",
    "demux_summary", "unmatched_groups", "offset_scores", "barcode_infer", "audit_pairs", "audit_variants", "ambiguous_nearby", "matrix_spearman",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = own.queries()
    queries["assign_levenshtein_k1"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    reads = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    rates = {f"{n}_reads_per_s": round(reads / times[n]) for n in ("assign_exact", "assign_hamming_k1", "assign_levenshtein_k1", "count_matrix")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "reads": reads, **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
