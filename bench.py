"""Times the headline queries; prints one JSON line. Warm runs, median of three."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafscribe.plans.queries import run  # noqa: E402
from leafscribe.session import local_session  # noqa: E402

HEADLINE = [
    "nms",
    "reading_order",
    "progress_rollup",
    "catalog_fts",
    "catalog_vector",
    "export_text",
    "region_completion",
    "serialize_for_save",
    "hit_test",
    "detokenise",
    "decode_lines",
    "ema_eta",
    "page_transcription",
]


def timed(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    # All rows and columns are computed, nothing is collected.
    run(name, spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores)
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(name, spark, folder)
        seconds[name] = round(statistics.median(timed(name, spark, folder) for _ in range(runs)), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
