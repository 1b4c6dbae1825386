"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data directory, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from glossmill.plans.catalogue import QUERIES
from glossmill.session import local_session

HEADLINE = (
    "w2_latest_per_key",
    "a6_ranked_functions",
    "a6_ranked_per_function",
    "r1_extract",
    "p8_entries",
    "r2_code_structure",
    "r3_structure_profile",
    "f6_length_limits",
    "a7_profile",
    "w3_running_average",
    "t13_normalise",
    "r4_language",
    "s6_clean_dataset",
    "a10_word_counts",
    "j5_encode",
    "q4_shift",
    "w4_context",
    "v3_subwords",
    "v4_encode",
    "v5_greedy_decode",
    "j8_innermost_span",
    "r5_suggest",
    "r6_suggestion_matrix",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "glossmill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["w2_latest_per_key"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
