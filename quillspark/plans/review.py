"""The review plan: documents in, issues and scored reviews out.

One narrow projection per document evaluates every selected rule; the issues are
exploded from that row. No shuffle happens before the score aggregate, and even the
score can be taken inside the row (``score_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed.profiles import DEFAULT_CONFIG
from ..functions.findings import ISSUE_ARRAY, none, rendered
from ..operators import config as C
from ..operators.parse import Doc, parse
from ..operators.rules import META, REGISTRY, SHADOWED, in_order


def settings(overrides: dict | None = None) -> dict:
    return {**DEFAULT_CONFIG, **(overrides or {})}


_BUILT: dict[tuple, Column] = {}


def rule_column(parsed: DataFrame, rule_id: str, cfg: dict, shadowed: bool = False) -> Column:
    """The rule's issue array. Columns are unresolved expressions over fixed column names, so one that was
    built once serves every frame with the same optional columns."""
    fn = (SHADOWED if shadowed else REGISTRY)[rule_id]
    optional = tuple(c in parsed.columns for c in ("blocks", "profile_id", "required_sections", "permissions"))
    key = (parsed.sparkSession.sparkContext.applicationId, fn, optional, tuple(sorted(cfg.items(), key=str)))
    if key not in _BUILT:
        _BUILT[key] = fn(Doc.of(parsed), cfg).cast(ISSUE_ARRAY)
    return _BUILT[key]


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per issue struct.

    The outer form on purpose: for the inner one the optimizer adds ``size(issues) > 0`` below the
    explode, which would evaluate every rule a second time.
    """
    return rows.select(*keep, F.posexplode_outer("issues").alias("seq", "issue")).where("issue IS NOT NULL")


def rule_issues(parsed: DataFrame, rule_id: str, overrides: dict | None = None, shadowed: bool = False,
                keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Issues of one rule over parsed documents."""
    found = rule_column(parsed, rule_id, settings(overrides), shadowed)
    return rendered(exploded(parsed.select(*keep, found.alias("issues")), *keep).drop("seq"))


def with_severity(found: Column, severity: str) -> Column:
    return F.transform(found, lambda i: i.withField("severity", F.lit(severity)))


def all_issues(parsed: DataFrame, packs: list[str] = (), overrides: dict | None = None, disabled=(),
               categories: str | None = "categories", formatting_alias: bool = False, rule_ids=None,
               severities: dict[str, str] | None = None) -> Column:
    """Every issue of a document as one array, in rule order.

    ``categories`` names the column with the categories in force; None runs every rule. ``disabled`` names rules or
    whole categories. ``severities`` gives the issues of a rule, or else of a category, another severity.
    """
    cfg = settings(overrides)
    ids = [r for r in C.selected_rules(in_order(rule_ids), list(packs), disabled) if META[r][0] not in disabled]
    gate = None
    if categories is not None:
        gate = C.enabled_categories(F.col(categories), formatting_alias=formatting_alias)
    arrays = []
    for rule_id in ids:
        found = rule_column(parsed, rule_id, cfg)
        wanted = (severities or {}).get(rule_id, (severities or {}).get(META[rule_id][0]))
        if wanted:
            found = with_severity(found, wanted)
        if gate is not None:
            found = F.when(C.gate_open(gate, META[rule_id][0]), found).otherwise(none())
        arrays.append(found)
    return F.concat(*arrays) if arrays else none()


def review_rows(docs: DataFrame, text: str = "text", packs: list[str] = (), overrides: dict | None = None,
                disabled=(), formatting_alias: bool = False, profiles=None, rule_ids=None, blocks=None,
                severities: dict[str, str] | None = None) -> DataFrame:
    """One row per document with its profile columns and the ``issues`` array.

    Expects ``doc_id, profile_id`` and the text column. Pack thresholds apply by key.
    """
    from ..operators.parse import with_blocks

    levels, pack_config = C.pack_settings(list(packs))
    with_profile = C.attach_profile(docs, rows=profiles)
    with_profile = with_profile.withColumn("permissions", C.merged_permissions(F.col("permissions"), levels))
    parsed = parse(with_profile, text)
    if blocks is not None:
        parsed = with_blocks(parsed, blocks)
    found = all_issues(parsed, packs, {**pack_config, **(overrides or {})}, disabled,
                       formatting_alias=formatting_alias, rule_ids=rule_ids, severities=severities)
    return parsed.withColumn("issues", found)


def issue_rows(reviewed: DataFrame, *keep: str, confidences: dict[str, int] | None = None) -> DataFrame:
    """The issues table: one row per issue with its sequence number in the document.

    ``confidences`` gives the issues of a rule, or else of a category, another confidence.
    """
    rows = rendered(exploded(reviewed, "doc_id", *keep))
    if not confidences:
        return rows
    given = F.create_map(*[F.lit(x) for pair in confidences.items() for x in pair])
    return rows.withColumn("confidence", F.coalesce(given[F.col("rule_id")], given[F.col("category")], F.col("confidence")))
