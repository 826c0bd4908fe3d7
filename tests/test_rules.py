"""Rules on small documents with hand-computed issues."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators.config import attach_profile
from quillspark.operators.parse import parse
from quillspark.operators.score import scored
from quillspark.plans.review import issue_rows, review_rows, rule_issues


def docs(spark, text, profile="general"):
    return spark.createDataFrame([(1, profile, text)], "doc_id bigint, profile_id string, text string")


def found(spark, rule, text, profile="general", **cfg):
    rows = rule_issues(parse(attach_profile(docs(spark, text, profile))), rule, cfg or None)
    return sorted((r.issue_id, r.severity, r.line_start) for r in rows.collect())


CASES = [
    ("structure.title-check", "plain text", "general", [("structure.no-title", "high", 1)]),
    ("structure.title-check", "## Part", "general", [("structure.title-not-h1", "medium", 1)]),
    ("structure.title-check", "# Part", "general", []),
    ("structure.abstract-check", "# T\n## Abstract\none two three\n## Next", "academic", [("structure.abstract-too-short", "medium", 2)]),
    ("structure.abstract-check", "# T", "business", [("structure.missing-abstract", "high", 1)]),
    ("structure.abstract-check", "# T\n## Abstract\n" + "word " * 60, "academic", []),
    ("structure.section-order", "# Conclusion\n# Introduction\n# Results", "academic", [("structure.wrong-order-introduction", "medium", 1)]),
    ("structure.duplicate-section", "# A b\n# a B", "general", [("structure.duplicate-section-a-b", "medium", 1)]),
    ("structure.heading-hierarchy", "# A\n### B\n#### C\n###### D", "general",
     [("structure-heading-gap-3", "medium", 1), ("structure-heading-gap-6", "medium", 1)]),
    ("writing.spelling", "We recieve it.\nFine.\nA seperate one", "general",
     [("writing.spelling-1-recieve", "low", 1), ("writing.spelling-3-seperate", "low", 3)]),
    ("writing.punctuation", "Good line.\nBad , line", "general", [("writing.punctuation-2", "low", 2)]),
    # the last two dots of an ellipsis are not followed by a third one, so the published pattern reports it
    ("writing.punctuation", "Wait... no", "general", [("writing.punctuation-1", "low", 1)]),
    ("writing.punctuation", "Wait.. no", "general", [("writing.punctuation-1", "low", 1)]),
    ("writing.overused-phrases", "a lot of\na lot of\na lot of", "general", [(f"writing.overused-{i}", "low", i) for i in (1, 2, 3)]),
    ("writing.terminology", "e-mail and email, email", "general", [("writing.terminology-e-mail", "low", 1)]),
    ("writing.contractions", "It's fine, don't", "academic", [("writing.contraction-1", "low", 1)] * 2),
    ("writing.contractions", "It's fine", "general", []),
    ("citation.reference-list", "# Introduction\nClaim [1].", "academic", [("citation-missing-reference-list", "high", 1)]),
    ("citation.style-consistency", "See [1].", "academic", [("citation.mixed-styles", "medium", 1)]),
    ("citation.year-validity", "(Smith, 1850) and (Lee, 2026)", "academic", [("citation.future-year-2026", "low", 1), ("citation.invalid-year-1850", "low", 1)]),
    ("citation.ieee-format", "[1] [3] [2]", "academic", [("citation.ieee-order", "medium", 1)]),
    ("citation.duplicate-reference", "# References\nA b\nC\na B", "academic", [("citation.duplicate-ref-2", "low", 1)]),
    ("format.heading-numbering", "# 1 One\n# Two", "general", [("format.mixed-numbering", "medium", 1)]),
    ("figure.numbering-sequential", "Figure 1: a\nFigure 3: b", "general", [("figure.numbering-gap-3", "medium", 1)]),
    ("figure.cross-reference", "Figure 1: a\nsee Figure 9", "general", [("figure.ref-mismatch-9", "medium", 2)]),
    ("logic.undefined-acronym", "The NLP (AI) and AI", "general", [("logic.undefined-acronym-NLP", "medium", 1)]),
    ("logic.missing-transition", "first\n\nnext line\nb\nc\n\nplain\nd\ne", "general", [("logic.missing-transition-2", "low", 5)]),
    ("logic.duplicate-content", "alpha bravo charlie delta echo\nx\nAlpha bravo charlie delta echo", "general", [("logic.duplicate-3", "medium", 3)]),
    ("logic.contradictions", "All of it, but some not", "general", [("logic.contradiction-abs-qual-0", "high", 1)]),
    ("compliance.safety-warning", "nothing", "sop", [("compliance-safety-warning", "high", 1)]),
    ("compliance.signatures", "Approved by A on 1/2/2024", "sop", []),
]


@pytest.mark.parametrize("rule,text,profile,want", CASES)
def test_rule(spark, rule, text, profile, want):
    assert found(spark, rule, text, profile) == want


def test_citations_without_references_lower_the_score(spark):
    row = scored(review_rows(docs(spark, "# Introduction\nClaim [1].", "academic"))).first()
    assert row.score < 100
    rules = {r.rule_id for r in issue_rows(review_rows(docs(spark, "# Introduction\nClaim [1].", "academic"))).collect()}
    assert "citation.reference-list" in rules
    # the stock profiles list `formatting`, the rules carry `format`: those never run unless aliased
    assert not any(r.startswith(("format.", "figure.")) for r in rules)
    aliased = {r.rule_id for r in issue_rows(review_rows(docs(spark, "# Introduction\n### Deep", "academic"), formatting_alias=True)).collect()}
    assert "format.heading-hierarchy-deep" in aliased


def test_pack_rules_run_without_packs_and_filter_with_them(spark):
    text = "# T\nSee [2] and [3]."
    every = {r.rule_id for r in issue_rows(review_rows(docs(spark, text, "academic"))).collect()}
    ieee = {r.rule_id for r in issue_rows(review_rows(docs(spark, text, "academic"), packs=["ieee"])).collect()}
    assert {"citation.ieee-format", "citation.acm-format"} <= every
    assert "citation.ieee-format" in ieee and "citation.acm-format" not in ieee


def test_scoring_modes(spark):
    text = "plain text , here"
    scores = {m: scored(review_rows(docs(spark, text)), m).first().score for m in ("strict", "standard", "relaxed")}
    assert scores["strict"] < scores["standard"] < scores["relaxed"]


def test_junk_gives_no_errors(spark):
    rows = spark.createDataFrame(
        [(1, "academic", ""), (2, "sop", None), (3, "business", "\r\n\r\n"), (4, "general", "[99999999999999999999999] \u0000 ((((")],
        "doc_id bigint, profile_id string, text string")
    out = scored(review_rows(rows, formatting_alias=True)).select("doc_id", "score", "n_issues").collect()
    assert len(out) == 4 and all(0 <= r.score <= 100 for r in out)


def test_same_result_on_one_and_eight_partitions(spark):
    base = spark.createDataFrame([(i, "academic", f"# T{i}\nIt is shown , [{i}] maybe.\n### Deep") for i in range(24)],
                                 "doc_id bigint, profile_id string, text string")
    one, eight = (sorted(map(tuple, issue_rows(review_rows(base.repartition(n))).collect())) for n in (1, 8))
    assert one == eight and one


def test_rules_add_no_shuffle(spark):
    big = docs(spark, "a").repartition(8)
    plan = review_rows(big)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0
