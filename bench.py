"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once for warm-up and ``BENCH_RUNS`` times for the clock; the best time counts. Results
are written to Spark's noop sink, so the whole result is computed and none of it reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webtraj.plans.registry import load  # noqa: E402
from webtraj.session import build_session  # noqa: E402

HEADLINE = (
    "failure_primary_cause", "failure_defect_prevalence", "defect_details", "failure_report_values", "routed_failures",
    "step_findings", "trial_accuracy", "running_accuracy", "reward_rows", "task_accuracy", "format_scores", "step_rewards",
    "extracted_commands", "parsed_actions", "brackets_to_angles", "static_text_deduped", "extracted_questions",
    "excluded_questions", "routed_samples", "split_counts", "task_segments", "step_histories", "task_samples",
    "seeded_shuffle", "budget_draw", "ratio_order", "row_parts", "adapted_rows", "canvas_plans", "image_token_costs",
    "sliding_means", "stale_windows", "pending_runs", "run_leaderboard", "cleaned_html", "page_tag_counts", "simplified_dom",
    "tree_texts", "viewport_boxes", "static_text_merged", "viewport_trees", "snapshot_texts", "page_segments", "dom_nodes",
    "hot_run_stale_windows", "early_stops", "repeated_samples", "repeated_actions", "trajectory_flags",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__python__sql__dataFrameDebugging__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for attempt in range(runs + 1):
            begin = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - begin
            if attempt:
                best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
