"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

HEADLINES = [
    "index_build", "file_ranges", "phrase_exact", "phrase_trigram", "phrase_missing", "phrase_bulk", "phrase_bulk_many", "fuzzy_d1", "fuzzy_d2", "fuzzy_join_bulk", "unified_search",
    "bm25_reference", "hybrid_documented", "prompt_tokens", "incremental_update", "persisted_roundtrip", "chunk_retrieval", "agent_search",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gramtrail.plans.catalogue import QUERIES, corpus

    took: dict[str, float] = {}
    began = time.perf_counter()
    own = corpus(spark, sf_dir)
    n = own.tokens.count()
    own.files.count()
    took["index_first_use"] = time.perf_counter() - began
    corpus(spark, sf_dir, "agent").tokens.count()
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    took["index_first_use"] = round(took["index_first_use"], 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "tokens": n, "tokens_per_sec_indexed": round(n / took["index_build"])}))
    spark.stop()


if __name__ == "__main__":
    main()
