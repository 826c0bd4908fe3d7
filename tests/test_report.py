"""The report's overview, severity counts and footer."""

from pyspark.sql import functions as F

from quillspark.operators.report import report
from quillspark.operators.score import scored
from quillspark.plans.review import review_rows


def test_report_counts_and_footer(spark):
    docs = spark.createDataFrame([(1, "academic", "# Title\n\nWe recieve it.\n\nEnd."), (2, "academic", "x")], "doc_id long, profile_id string, text string")
    reviewed = scored(review_rows(docs, rule_ids=["writing.spelling"]))
    critical = F.transform("issues", lambda i: i.withField("severity", F.lit("critical")))
    rows = reviewed.withColumns({"tables": F.lit(3), "figures": F.lit(0), "issues": critical})
    one, two = (r.report for r in report(rows).orderBy("doc_id").collect())
    for line in ("| Paragraphs | 3 |", "| Headings | 1 |", "| Tables | 3 |", "| Figures | 0 |", "| 🔴 Critical | 1 |"):
        assert line in one.split("\n")
    assert "**Severity:** Critical" in one and one.endswith("\n---\n_Generated by the document review_")
    assert "✅ No issues were detected." in two and "Critical" not in two
    plain = report(reviewed).orderBy("doc_id").first().report
    assert "| Tables |" not in plain and "| Paragraphs | 3 |" in plain
    assert "| Đoạn | 3 |" in report(rows, "vi").orderBy("doc_id").first().report
