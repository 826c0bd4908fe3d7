"""The rule registry: rule id -> function(Doc, config) -> Column of issue structs.

``rule`` registers a rule of your own; the id is its public key and decides the category
through RULES in ``fixed.catalog`` or the ``category`` argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from ...fixed.catalog import RULES as CATALOG
from ..parse import Doc
from . import citation, compliance, layout, logic, structure, writing

RuleFn = Callable[[Doc, dict], Column]

REGISTRY: dict[str, RuleFn] = {
    **structure.RULES, **writing.RULES, **citation.RULES, **layout.RULES, **logic.RULES, **compliance.RULES,
}
SHADOWED: dict[str, RuleFn] = {**writing.SHADOWED, **compliance.SHADOWED}
META: dict[str, tuple[str, int, str]] = dict(CATALOG)
OPTIONAL: set[str] = set()


def rule(rule_id: str, category: str, priority: int = 0, pack: str = "", enabled: bool = True):
    """Register ``fn(doc, config) -> Column[array<issue>]`` under an id of your own.

    A rule that is not ``enabled`` runs only where it is named.
    """

    def add(fn: RuleFn) -> RuleFn:
        REGISTRY[rule_id] = fn
        META[rule_id] = (category, priority, pack)
        (OPTIONAL.discard if enabled else OPTIONAL.add)(rule_id)
        return fn

    return add


def in_order(rule_ids=None) -> list[str]:
    """Priority descending, then id: the order in which issues come out."""
    ids = [r for r in REGISTRY if r not in OPTIONAL] if rule_ids is None else rule_ids
    return sorted(ids, key=lambda r: (-META[r][1], r))
