"""Limits are off by default; the published ones apply when a configuration names them. Wrong answers of earlier versions."""

import pytest
from pyspark.sql import functions as F

from quillspark.fixed.profiles import PUBLISHED_LIMITS
from quillspark.operators import config as C, fix as FX, ops as O, safety as L
from quillspark.operators.parse import parse
from quillspark.plans import store as S
from quillspark.plans.review import rule_issues

CASES = {
    "writing.grammar": ("\n".join(f"Line {i} is irregardless of it." for i in range(13)), 13, 10),
    "writing.spelling": ("\n".join(f"We recieve item {i}." for i in range(18)), 18, 15),
    "writing.punctuation": ("\n".join(f"Item {i} ,here" for i in range(12)), 12, 10),
    "writing.passive-voice": ("\n".join(f"Part {i} was tested." for i in range(8)), 8, 5),
    "writing.hedging": ("\n".join(f"Part {i} perhaps works." for i in range(6)), 6, 3),
    "writing.overused-phrases": ("\n".join("In order to see, it is important to note that." for _ in range(4)), None, 2),
    "logic.duplicate-content": ("\n".join("several words repeated again within every single line" for _ in range(9)), 8, 5),
    "citation.duplicate-reference": ("# References\n" + "x" * 90 + " one\n" + "x" * 90 + " two\n", 0, 1),
}


@pytest.mark.parametrize("rule_id", CASES)
def test_limits(spark, rule_id):
    text, whole, limited = CASES[rule_id]
    docs = spark.createDataFrame([(1, "academic", text)], "doc_id long, profile_id string, text string")
    parsed = parse(C.attach_profile(docs))
    found = rule_issues(parsed, rule_id).count()
    assert found == whole if whole is not None else found > limited
    assert rule_issues(parsed, rule_id, PUBLISHED_LIMITS).count() == limited


def test_keys_of_letters_alone_are_found(spark):
    docs = spark.createDataFrame([(1, "key sk-abcdefghijklmnopqrstuvwxyz end"), (2, "٣١٤-٥٥٥-١٢٣٤ mail a@b.cd"), (3, "plain")], "doc_id long, text string")
    rows = {(r.doc_id, r.kind) for r in L.pii_rows(docs).collect()}
    assert (1, "api_key_like") in rows and (2, "email") in rows and not any(d == 3 for d, _ in rows)
    many = spark.createDataFrame([(1, " ".join(f"u{i}@example.com" for i in range(9)))], "doc_id long, text string")
    assert L.pii_rows(many).count() == 9 and L.pii_rows(many, limit=5).count() == 5


def test_issue_events_fold_by_issue(spark):
    issues = spark.createDataFrame([("i1", 7, "writing", "open")], "id string, session_id long, category string, status string")
    events = spark.createDataFrame(
        [("issue", "i1", "writing", "resolved", 1), ("issue", "i1", None, "ignored", 2)], "target string, key string, category string, status string, at long")
    assert [(r.id, r.status, r.resolved_at) for r in S.current_status(issues, events).collect()] == [("i1", "ignored", 2)]


def test_percentiles_leave_out_nulls_and_split_outliers(spark):
    rows = [("a", None), ("a", 3.0), ("a", float("nan"))] + [("b", float(i)) for i in range(1, 1001)] + [("b", 1e18)]
    got = {(r.name, r.quantile): r.value for r in O.nearest_rank(spark.createDataFrame(rows, "name string, value double"), [0.5, 0.99]).collect()}
    assert got == {("a", 0.5): 3.0, ("a", 0.99): 3.0, ("b", 0.5): 501.0, ("b", 0.99): 991.0}


def test_heading_style(spark):
    lines = spark.createDataFrame([("## Results",), ("###Deep",), ("#  Wide",), ("#One",), ("text # no",)], "t string")
    assert [r[0] for r in lines.select(FX.heading_style(F.col("t"))).collect()] == ["## Results", "### Deep", "#  Wide", "# One", "text # no"]
    assert lines.select(FX.heading_style(F.col("t"), published=True)).first()[0] == "# # Results"


def test_an_offset_needs_a_limit(spark):
    with pytest.raises(ValueError):
        S.page(spark.range(3), ["id"], None, 1)
