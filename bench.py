"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.session import build_session
from plumbline.suite import QUERIES

HEADLINE = [
    "composite_scores", "m3_recall_at_10", "m4_citation_validity", "m5_evidence_coverage", "m6_numeric_gaps", "m8_redlines",
    "m9_text_structure_documents", "bootstrap_composite_ci", "bootstrap_poisson_ci", "split_aggregate", "score_breakdowns",
    "a03_duplicate_ids", "a04_content_collisions", "a06_document_stub_collisions", "a07_copied_scenarios", "a07_jaccard", "nearest_ten_pairs", "a12_diversity",
    "distance_histogram", "derived_labels", "scenario_fingerprints", "review_verdict", "review_memo_head", "numeric_envelope",
    "round_deltas", "judge_responses", "stitched_payloads", "run_state_fold", "run_state_stream", "stratified_splits",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    seconds: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": root.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
