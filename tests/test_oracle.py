"""Registered queries against DuckDB; QUILL_FULL=1 runs every one of them."""

import os

import pytest

from tests.compare import difference, oracle
from workload import registry

SF = os.environ.get("QUILL_SF_DIR", "/root/testdata/sf0.001")
QUICK = ["p01_", "p03_", "p06_", "p10_", "d06_", "c04_", "c10_", "t02_", "i03_", "g02_overall_score_strict", "f03_", "f09_", "f20_", "l02_", "l06_",
         "q05_", "q08_dashboard", "q10_", "q12_", "q14_", "o05_audit_c", "o08_", "s05_", "s14_", "st4_", "r05_", "r12_", "r46_", "r55_"]
ORACLES = registry.oracles()
NAMES = [n for n in ORACLES if os.environ.get("QUILL_FULL") or n.startswith(tuple(QUICK))]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert difference(registry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_every_survey_group_is_registered():
    names = registry.queries()
    rules = [n for n in names if n[0] == "r" and n[1:3].isdigit()]
    assert len(rules) == 72
    assert set(ORACLES) <= set(names)
