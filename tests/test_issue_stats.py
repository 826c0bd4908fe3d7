"""Counts of issues per session: tasks get about as many rows each, however large the table."""

from quillspark.plans.store import issue_stats


def test_rows_are_dealt_before_they_are_counted(spark):
    rows = [(i % 40, "high" if i % 3 else "minor", "logic", "open") for i in range(400)]
    got = issue_stats(spark.createDataFrame(rows, "session_id long, severity string, category string, status string"), rows=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2 and plan.count(", 8), REPARTITION_BY_NUM") == 2
    found = {(r.session_id, r.dimension, r.value): r.n for r in got.collect()}
    for s in range(40):
        high = sum(1 for i in range(s, 400, 40) if i % 3)
        assert {(d, v): n for (k, d, v), n in found.items() if k == s} == {
            ("severity", "high"): high, ("severity", "minor"): 10 - high, ("severity", "medium"): 0, ("severity", "low"): 0,
            ("category", "logic"): 10, ("status", "open"): 10, ("status", "resolved"): 0, ("status", "ignored"): 0}
