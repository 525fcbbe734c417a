"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from veilspan import plans
from veilspan.session import local_session

HEADLINE = (
    "e05_carryover_scoreboard",
    "e05_left_out_phrases",
    "c15_document_identifiers",
    "c15_priority_resolution",
    "d15_scrub_chain",
    "e04_fingerprint_hits",
    "d03_replaced_text",
    "e08_holdout_contamination",
    "e19_ngram_overlap",
    "e10_scoped_search",
    "f10_wilson_interval",
    "f16_percentile_by_group",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, spark__veilspan__spread=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.load().QUERIES
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
