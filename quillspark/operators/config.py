"""Profiles, packs, permissions and overrides: small tables resolved next to the documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed import profiles as P
from ..fixed.detection import TYPE_PROFILE
from ..fixed.catalog import RULES
from ..functions import rx

PROFILE_SCHEMA = (
    "profile_id string, profile_name string, categories array<string>, weights map<string,int>, "
    "permissions map<string,int>, required_sections array<string>, model_focus array<string>"
)
PACK_SCHEMA = (
    "pack_id string, pack_name string, profile_id string, permissions map<string,int>, config map<string,string>"
)


def profile_table(spark: SparkSession, rows=None) -> DataFrame:
    """Profile rows; seven stock profiles unless rows from a config source are given."""
    rows = rows or [(i, n, list(w), w, p, s, f) for i, n, w, p, s, f in P.PROFILES]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def pack_table(spark: SparkSession, rows=None) -> DataFrame:
    """Knowledge packs."""
    rows = rows or [(i, n, pr, pe, {k: str(v) for k, v in c.items()}) for i, n, pr, pe, c in P.PACKS]
    return spark.createDataFrame(rows, PACK_SCHEMA)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(r, c, p, k) for r, (c, p, k) in RULES.items()], "rule_id string, category string, priority int, pack_id string")


def attach_profile(docs: DataFrame, requested: str = "profile_id", detected: str | None = None,
                   rows=None) -> DataFrame:
    """Resolve ``auto`` to the detected profile, then join the profile row (the stock ones, a handful, by broadcast)."""
    wanted = F.col(requested)
    if detected is not None:
        wanted = F.coalesce(F.nullif(wanted, F.lit("auto")), F.col(detected))
    table = profile_table(docs.sparkSession, rows)
    return docs.withColumn("profile_id", wanted).join(F.broadcast(table) if rows is None else table, "profile_id", "left")


def profile_of_type(document_type: Column) -> Column:
    """D07."""
    mapping = F.create_map(*[F.lit(x) for pair in TYPE_PROFILE.items() for x in pair])
    return F.coalesce(mapping[document_type], F.lit("general"))


def pack_settings(pack_ids: list[str]) -> tuple[dict[str, int], dict]:
    """C04 and C05 for a selection: highest permission per category, later pack's config wins."""
    levels: dict[str, int] = {}
    config: dict = {}
    known = {row[0]: row for row in P.PACKS}
    for pack_id in pack_ids:
        if pack_id in known:
            for category, level in known[pack_id][3].items():
                levels[category] = max(level, levels.get(category, 0))
            config.update(known[pack_id][4])
    return levels, config


def merged_permissions(permissions: Column, levels: dict[str, int]) -> Column:
    """C04 as a column: greatest of profile and pack level per category."""
    if not levels:
        return permissions
    packs = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return F.map_zip_with(permissions, packs, lambda _, a, b: F.greatest(a, b))


def permission_rows(spark: SparkSession, selection: DataFrame) -> DataFrame:
    """C04 over a table: (request_id, profile_id, pack_ids) -> (request_id, category, level)."""
    profiles = profile_table(spark).select("profile_id", F.explode("permissions").alias("category", "level"))
    packs = pack_table(spark).select("pack_id", F.explode("permissions").alias("category", "level"))
    own = selection.join(F.broadcast(profiles), "profile_id").select("request_id", "category", "level")
    chosen = selection.select("request_id", F.explode("pack_ids").alias("pack_id"))
    extra = chosen.join(F.broadcast(packs), "pack_id").select("request_id", "category", "level")
    return own.unionByName(extra).groupBy("request_id", "category").agg(F.max("level").alias("level"))


def config_rows(spark: SparkSession, selection: DataFrame) -> DataFrame:
    """C05 over a table: later pack wins per key."""
    chosen = selection.select("request_id", F.posexplode("pack_ids").alias("pos", "pack_id"))
    packs = pack_table(spark).select("pack_id", F.explode("config").alias("key", "value"))
    return (
        chosen.join(F.broadcast(packs), "pack_id")
        .groupBy("request_id", "key").agg(F.max_by("value", "pos").alias("value"))
    )


def enabled_categories(profile_categories: Column, requested: Column | None = None,
                       formatting_alias: bool = False) -> Column:
    """Requested ∩ profile categories. An empty result switches the gate off (kept, see README)."""
    gate = profile_categories
    if requested is not None:
        gate = F.when(F.size(requested) > 0, F.array_intersect(requested, profile_categories)).otherwise(gate)
    if formatting_alias:
        gate = F.when(F.array_contains(gate, "formatting"),
                      F.array_union(gate, F.array(F.lit("format"), F.lit("figure_table")))).otherwise(gate)
    return gate


def gate_open(categories: Column, category: str) -> Column:
    return (F.size(categories) == 0) | F.array_contains(categories, category)


def selected_rules(rule_ids, packs: list[str], disabled=()) -> list[str]:
    """Disabled rules out; with packs chosen, rules of other packs out (with none, all stay)."""
    return [r for r in rule_ids
            if r not in disabled and (not RULES.get(r, ("", 0, ""))[2] or not packs or RULES[r][2] in packs)]


def override_rows(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rule and category overrides -> enabled flag and severity per rule.

    ``overrides(scope, key, enabled, severity)``, scope ``rule`` or ``category``; the rule row wins for severity,
    either row can disable.
    """
    by_rule = overrides.where("scope = 'rule'").select(
        F.col("key").alias("rule_id"), F.col("enabled").alias("rule_on"), F.col("severity").alias("rule_severity"))
    by_category = overrides.where("scope = 'category'").select(
        F.col("key").alias("category"), F.col("enabled").alias("category_on"),
        F.col("severity").alias("category_severity"))
    return (
        catalog.join(by_rule, "rule_id", "left").join(by_category, "category", "left")
        .select(
            "rule_id", "category",
            (F.coalesce("rule_on", F.lit(True)) & F.coalesce("category_on", F.lit(True))).alias("enabled"),
            F.coalesce("rule_severity", "category_severity").alias("severity"))
    )


def custom_profiles(requests: DataFrame, rows=None) -> DataFrame:
    """Custom evaluation profiles over a base profile.

    ``requests(custom_id, base_profile_id, enabled_categories, scoring)``; adds the categories in force, their
    weights (``equal`` -> 1 each, else the base weight or 1) and the categories the base does not know.
    """
    base = profile_table(requests.sparkSession, rows).select(
        F.col("profile_id").alias("base_profile_id"), F.col("categories").alias("base_categories"),
        F.col("weights").alias("base_weights"))
    joined = requests.join(F.broadcast(base) if rows is None else base, "base_profile_id")
    chosen = F.array_distinct(
        F.when(F.size("enabled_categories") > 0, F.col("enabled_categories")).otherwise(F.col("base_categories")))
    weights = F.map_from_arrays(chosen, F.transform(
        chosen, lambda c: F.when(F.col("scoring") == "equal", F.lit(1))
        .otherwise(F.coalesce(F.col("base_weights")[c], F.lit(1)))))
    return joined.select(
        "custom_id", "base_profile_id", chosen.alias("categories"), weights.alias("weights"),
        F.array_sort(F.array_except(chosen, F.col("base_categories"))).alias("unknown_categories"))


def model_review_decision(docs: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Which documents deserve a model pass, and why.

    Needs ``text, profile_id, permissions, categories, model_focus``; ``issues(doc_id, category)`` widens the scope.
    """
    semantic = rx.strings(P.SEMANTIC_CATEGORIES)
    if issues is not None:
        touched = issues.where(F.col("category").isin(P.SEMANTIC_CATEGORIES)).groupBy("doc_id").agg(
            F.count("*").alias("_semantic_issues"))
        docs = docs.join(touched, "doc_id", "left")
    else:
        docs = docs.withColumn("_semantic_issues", F.lit(0).cast("bigint"))
    scope = F.array_intersect(F.col("categories"), semantic)
    levels = F.transform(scope, lambda c: F.coalesce(F.col("permissions")[c], F.lit(0)))
    reason = (
        F.when(rx.strip(F.col("text")) == "", F.lit("Document is empty."))
        .when((F.col("profile_id") == "sop") & F.array_contains("categories", "writing"),
              F.lit("SOP profiles disable AI-assisted rewriting and writing enhancement."))
        .when((F.coalesce("_semantic_issues", F.lit(0)) == 0) & (F.size(scope) == 0) & (F.size("model_focus") == 0),
              F.lit("Rule engine handled the review successfully; AI review skipped."))
        .when(F.array_max(levels) < 2,
              F.lit("Profile does not allow AI-assisted explanation or rewrite actions."))
        .when(rx.word_count(F.col("text")) < 80, F.lit("Document is too short for AI review to add value."))
    )
    return docs.withColumns({
        "should_run": reason.isNull(),
        "reason": F.coalesce(reason, F.lit(
            "Document contains high-value writing or logic issues that can benefit from AI assistance.")),
        "focus": F.when(reason.isNull(), F.when(
            F.size("model_focus") > 0, F.col("model_focus")).otherwise(F.array_sort(scope)))
        .otherwise(F.array().cast("array<string>")),
    }).drop("_semantic_issues")
