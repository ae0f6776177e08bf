"""Headline queries, timed: BENCH_SF_DIR and BENCH_CPUS choose data and cores. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a1_gate_report", "a4_contact_extract", "a5_experience_estimate", "b4_placeholder_rows", "c1_token_index",
    "c4_keyword_match", "c6_most_missed", "d3_date_consistency", "d5_score_total", "d6_score_after", "e8_flags_all",
    "e9_flag_gate", "f1_skill_breakdown", "f4_skill_route", "g1_semantic_match", "g3_evidence_table", "h2_change_dedupe",
    "h5_revert_apply", "i1_entry_segment", "i5_text_apply", "j1_score_delta_report", "k2_bad_transitions",
    "f3_skill_merge", "i3_entry_align", "j2_outcome_table", "j3_analysis_table", "k1_stream_score",
    "g1_top_jobs_all", "i3_entry_align_prefix",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    from rolefit.plans.registry import QUERIES
    from rolefit.session import SETTINGS

    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("rolefit-bench")
               .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rolefit-bench-"))  # local[n]: one machine
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").write.format("noop").mode("overwrite").save()  # start the JVM up

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    pairs = QUERIES["d7_score_bands"](spark, folder).count() if os.environ.get("BENCH_PAIRS") else None
    spark.stop()
    result = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
              "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if pairs:
        result["pairs_scored_per_sec"] = round(pairs / seconds["d5_score_total"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
