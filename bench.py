"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "review_documents", "review_drafts", "r10_writing_grammar", "r51_logic_undefined_acronym", "r05_structure_empty_section",
    "r46_figure_cross_reference", "p01_lines", "p06_sentences", "p07_html_blocks", "p17_boundary_chunks", "d06_document_type",
    "g02_overall_score_standard", "g06_issue_summary", "l01_pii", "l02_redaction", "f21_f22_fixed_documents", "f26_line_diff",
    "c03_pack_filter", "q03_all_issues", "q05_issue_history", "q08_dashboard", "q10_compare_runs", "q12_issue_stats", "q14_timeline",
    "o01_histogram", "o05_audit_chains", "o08_percentiles", "st3_first_seen",
]


def main() -> None:
    from quillspark import session
    from workload import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session.build(
        "bench", f"local[{cpus}]", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    wanted = sys.argv[1:] or HEADLINE
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times, built = {}, {}
    for name in wanted:
        started = time.perf_counter()
        frame = queries[name](spark, sf_dir)
        built[name] = round(time.perf_counter() - started, 3)
        frame.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    result = {
        "metric": "headline queries, wall clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "documents": n_docs,
        "plan_build": built}
    if "review_documents" in times:
        result["review_ms_per_document"] = round(times["review_documents"] * 1000 / n_docs, 3)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
