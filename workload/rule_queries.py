"""One query and one oracle per review rule."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.config import attach_profile
from quillspark.operators.parse import parse, with_blocks
from quillspark.plans.review import rule_issues

from .blocks import BLOCKS_SQL, blocks
from .drafts import drafts
from .rule_oracles import all_rules
from .sql import ISSUE_COLUMNS, base

# thresholds that differ from the stock ones, so that the long forms of a rule show up too
CONFIG = {
    "structure.section-length-variance": {"variance_ratio": 3},
    "format.section-length": {"max_words": 400},
    "compliance.mandatory-sections": {"pack_id": "fda"},
    "logic.unsupported-conclusion": {"unsupported_conclusion": True},
}
ORDER = [
    "structure.title-check", "structure.abstract-check", "structure.key-sections-check", "structure.section-order",
    "structure.empty-section", "structure.duplicate-section", "structure.section-length-variance",
    "structure.keywords-check", "structure.sop-required-fields",
    "writing.grammar", "writing.spelling", "writing.punctuation", "writing.readability", "writing.overused-phrases",
    "writing.terminology", "writing.passive-voice", "writing.hedging", "writing.weak-wording", "writing.verbosity",
    "writing.contractions", "shadow:writing.sentence-length", "writing.repetition", "writing.tone-consistency",
    "citation.in-text-reference-mismatch", "citation.year-validity", "citation.apa-format", "citation.apa-heading",
    "citation.ieee-format", "citation.doi-validation", "citation.acm-format", "citation.acm-reference-format",
    "citation.nature-format", "citation.springer-format", "citation.elsevier-format", "citation.style-consistency",
    "citation.duplicate-reference",
    "format.heading-numbering", "format.heading-hierarchy-deep", "format.required-sections-depth",
    "format.section-length", "format.block-format",
    "figure.numbering-sequential", "figure.table-numbering", "figure.missing-caption", "figure.missing-table-caption",
    "figure.cross-reference", "figure.caption-format", "figure.cited-missing", "figure.table-cited-missing",
    "figure.equation-numbering",
    "logic.undefined-acronym", "logic.missing-transition", "logic.duplicate-content", "logic.scope-mismatch",
    "logic.contradictions", "logic.claim-without-evidence", "logic.unsupported-conclusion", "logic.number-consistency",
    "shadow:compliance.safety-warning", "compliance.signatures", "compliance.revision-history", "compliance.iso9001",
    "compliance.fda", "compliance.who", "compliance.sop-validation", "compliance.versioning",
    "compliance.mandatory-sections",
    "writing.sentence-length", "structure.required-section", "structure.heading-hierarchy", "citation.reference-list",
    "compliance.safety-warning",
]
USES_BLOCKS = ("format.block-format", "figure.")


def name_of(number: int, rule: str) -> str:
    plain = rule.replace("shadow:", "").replace(".", "_").replace("-", "_")
    return f"r{number:02d}_{plain}" + ("_shadowed" if rule.startswith("shadow:") else "")


def run(rule: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse(attach_profile(drafts(spark, sf_dir)))
    if rule.startswith(USES_BLOCKS):
        parsed = with_blocks(parsed, blocks(spark, sf_dir))
    shadowed = rule.startswith("shadow:")
    plain = rule.removeprefix("shadow:")
    return rule_issues(parsed, plain, CONFIG.get(plain), shadowed).select(*ISSUE_COLUMNS)


def queries() -> dict:
    return {name_of(i, rule): partial(run, rule) for i, rule in enumerate(ORDER, 1)}


def oracles() -> dict[str, str]:
    sql = all_rules()
    return {
        name_of(i, rule): base() + (BLOCKS_SQL if rule.startswith(USES_BLOCKS) else "") + sql[rule]
        for i, rule in enumerate(ORDER, 1)
    }
