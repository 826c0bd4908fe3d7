"""Rules over lines read the parsed tokens; they do not parse the document again at every line."""

import re

import pytest

from tests.test_rules import docs
from quillspark.operators.config import attach_profile
from quillspark.operators.parse import parse
from quillspark.plans.review import rule_issues

LINE_RULES = ["writing.passive-voice", "writing.hedging", "writing.weak-wording", "writing.verbosity", "logic.claim-without-evidence"]


@pytest.mark.parametrize("rule", LINE_RULES)
def test_tokens_are_made_once_a_document(spark, rule):
    plan = rule_issues(parse(attach_profile(docs(spark, "Perhaps it is so."))), rule)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(arrays_overlap|exists)\(transform\(", plan)


def test_the_flag_of_odd_letters_is_made_once_a_document(spark):
    plan = rule_issues(parse(attach_profile(docs(spark, "Perhaps it is so."))), "writing.hedging")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"WHEN \(?RLIKE\(", plan)


@pytest.mark.parametrize("rule, text, lines", [
    ("writing.hedging", "Plain.\nPerhapſ so, in general.", [2, 2]),  # a long s matches s in any case
    ("writing.grammar", "It would of been.\nThe house to let.\nTheir effect is\nmore then a day", [1, 2, 3, 4]),
    ("writing.overused-phrases", "a lot of words\nin other words, the fact that\nresearch gaps", [1, 2, 2, 3]),
    ("writing.contractions", "It's fine, let's go\nits a can", [1, 1]),
    ("writing.repetition", "Thus.\nthus, THUS and thus", [1]),
    ("writing.passive-voice", "It was\nopened and is seen", [2]),
    ("logic.claim-without-evidence", "This proves it.\nIt is clear that no.\nThis is all [1]\nWithout a doubt [2]", [1, 2]),
    ("logic.contradictions", "All of it.\nSome of all\nmost", [2]),
    ("structure.empty-section", "# A\n## B\nC and so on, with one, two, three, four, five words\n## C\none two three four five six seven eight nine ten", [2]),
])
def test_guards_lose_no_line(spark, rule, text, lines):
    rows = rule_issues(parse(attach_profile(docs(spark, text, "academic"))), rule)
    assert sorted(r.line_start for r in rows.collect()) == lines
