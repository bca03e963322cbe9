"""Times the headline queries: one JSON line with the median seconds of each over a noop sink, after one warm-up run."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ("url_canonicalize", "exact_key", "exact_key_navigate", "exact_match_asof", "tokens", "bm25_local", "redact_text", "cosine_topk", "hybrid_rank", "curl_fingerprint", "semantic_text")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from recallspark.plans.queries import QUERIES

    took: dict[str, float] = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs + 1):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        took[name] = round(statistics.median(each[1:] or each), 3)
        print(name, took[name], file=sys.stderr)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total of median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1].rstrip(".")) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
