"""Headline queries, timed warm: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ["pretok_bytelevel", "split_isolated", "norm_bert_clean", "byte_map", "encode_full", "decode_roundtrip", "token_count_by_lang", "chat_labels", "html_attr_count"]
RUNS = 5


def main() -> None:
    from tessera.plans.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr)
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("count(1) n", "sum(length(text)) c").first()
    spark.stop()
    rates = {n: {"docs_per_s": round(sizes["n"] / took[n]), "chars_per_s": round(sizes["c"] / took[n])} for n in ("encode_full", "decode_roundtrip")}
    print(json.dumps({"metric": "headline queries, median of warm runs, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "cores": int(cpus), "rates": rates}))


if __name__ == "__main__":
    main()
