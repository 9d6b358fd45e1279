"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's result is consumed whole, without being collected. One warm-up run,
then the median of three. ``K4_build_index`` builds an index per run; the
retrieval and answer queries ask an index that was built before, as a user does.
Rows in and out, cores and memory are part of the line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pagewell.plans.queries import REGISTRY
from pagewell.session import local_session

HEADLINE = {
    "T1_fixed_chunks": "documents",
    "T2_sentence_packing": "documents",
    "T5_embed_chunks": "documents",
    "K4_build_index": "documents",
    "R1_cosine_top_k": "embeddings",
    "R2_approximate_top_k": "embeddings",
    "R4_rerank": "benchmark",
    "R5_two_stage": "benchmark",
    "P8_answer": "benchmark",
}
RUNS = 3
MEMORY = "16g"


def consume(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, MEMORY)
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rows = {}, {}
    for name, table in HEADLINE.items():
        consume(spark, name, folder)
        seconds[name] = round(statistics.median(consume(spark, name, folder) for _ in range(RUNS)), 3)
        rows[name] = {
            "in": spark.read.parquet(f"{folder}/{table}.parquet").count(),
            "out": REGISTRY[name](spark, folder).count(),
        }
    print(
        json.dumps(
            {
                "metric": "sum of median seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
                "memory": MEMORY,
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
