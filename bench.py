"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_topk", "rrf_fusion", "corpus_stats", "exact_duplicates", "near_duplicates", "make_passages", "html_extract",
    "relevance_status", "keyword_discovery", "check_citations", "validate_items", "latest_results", "assess_agreement", "spend_ledger",
    "budget_admission", "export_long",
]


def main() -> None:
    from attesta.plans import catalog
    from attesta.session import local_session

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    registered["url_domain"](spark, directory).write.format("noop").mode("overwrite").save()  # start the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
