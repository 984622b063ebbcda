"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradus.plans.queries import QUERIES  # noqa: E402
from gradus.session import build_session  # noqa: E402

HEADLINE = [
    "score_active",
    "score_all",
    "group_advantages",
    "reward_summary_by_language",
    "reward_summary_by_quality",
    "correctness",
    "int_answer",
    "strict_format",
    "soft_format",
    "xml_count",
    "format_adherence",
    "cpp_syntax",
    "reasoning_coherence",
    "logical_consistency",
    "cp_thinking",
    "answer_confidence",
    "strict_start",
    "introspection",
    "strict_output_format",
    "cpp_markdown",
    "python_reward",
    "problem_record",
    "page_parts",
    "submission_rows",
    "submission_code",
    "description",
    "page_links",
    "first_accepted",
    "attach_solution",
    "skip_collected",
    "skip_collected_by_key",
    "build_prompt",
    "length_budget",
    "json_round_trip",
    "collect_new",
    "scored_stream",
    "collected_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # Start the JVM's and the Python workers' engines before timing.
    run("score_active")
    run("python_reward")
    seconds = {name: run(name) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
