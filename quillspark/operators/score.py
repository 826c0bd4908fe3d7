"""Scores, readiness, insights, recommendations, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import profiles as P
from ..functions import rx
from ..functions.findings import rendered, rule_of


def deduction(severity: Column, mode: str = "standard") -> Column:
    """Points lost per issue; halves go to even, as in the reference."""
    factor = P.SCORING_MODES.get(mode, 1.0)
    choice = None
    for name, points in P.DEDUCTIONS.items():
        lost = F.lit(int(round(points * factor)))
        choice = F.when(severity == name, lost) if choice is None else choice.when(severity == name, lost)
    return choice.otherwise(F.lit(0))


def category_scores(issues: Column, categories: Column, mode: str = "standard") -> Column:
    """G01 inside the row: map category -> score from a document's issue array."""

    def per_category(found: Column) -> Column:
        def points(category: Column) -> Column:
            lost = F.aggregate(
                F.filter(found, lambda i: i["category"] == category), F.lit(0),
                lambda acc, i: acc + deduction(i["severity"], mode))
            return F.greatest(F.lit(0), F.lit(100) - lost)

        return F.map_from_arrays(categories, F.transform(categories, points))

    # bound once: an expression used inside a lambda would run again for every category
    return rx.let(issues, per_category)


def overall(scores: Column, weights: Column) -> Column:
    """Weighted mean, ties to even."""

    def mean(scores: Column) -> Column:
        total = F.aggregate(F.map_values(weights), F.lit(0), lambda acc, w: acc + w)
        weighted = F.aggregate(
            F.map_entries(weights), F.lit(0), lambda acc, e: acc + F.coalesce(scores[e["key"]], F.lit(0)) * e["value"])
        return F.bround(weighted / F.when(total == 0, F.lit(1)).otherwise(total)).cast("int")

    return rx.let(scores, mean)


def readiness(score: Column, severe: Column) -> Column:
    """More than five high or critical issues keep a document a draft."""
    return (
        F.when((severe > 5) | (score < 50), F.lit("draft")).when(score < 70, F.lit("review_needed"))
        .when(score < 85, F.lit("almost_ready")).otherwise(F.lit("ready"))
    )


def severe_count(issues: Column) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"].isin("critical", "high")))


def fixable_count(issues: Column) -> Column:
    return F.size(F.filter(issues, lambda i: i["fix"]))


def scored(reviewed: DataFrame, mode: str = "standard") -> DataFrame:
    """Reviews with ``category_scores``, ``score``, ``readiness`` and counts; no shuffle."""
    out = reviewed.withColumn("category_scores", category_scores(F.col("issues"), F.col("categories"), mode))
    out = out.withColumn("score", overall(F.col("category_scores"), F.col("weights")))
    return out.withColumns({
        "n_issues": F.size("issues"),
        "n_severe": severe_count(F.col("issues")),
        "n_fixable": fixable_count(F.col("issues")),
        "readiness": readiness(F.col("score"), severe_count(F.col("issues"))),
        "improvement_potential": F.least(fixable_count(F.col("issues")) * 5, F.lit(30)),
        "summary": F.concat(
            F.lit("Found "), F.size("issues").cast("string"), F.lit(" issue(s) across "),
            F.size("categories").cast("string"), F.lit(" enabled category/categories.")),
    })


def score_issue_table(reviews: DataFrame, issues: DataFrame, mode: str = "standard") -> DataFrame:
    """G01 + G02 from stored tables: partial sums per (document, category) come before the shuffle."""
    lost = issues.groupBy("doc_id", "category").agg(F.sum(deduction(F.col("severity"), mode)).alias("lost"))
    per_category = reviews.select("doc_id", F.explode("weights").alias("category", "weight")).join(
        lost, ["doc_id", "category"], "left").withColumn(
        "category_score", F.greatest(F.lit(0), F.lit(100) - F.coalesce("lost", F.lit(0))))
    return per_category.groupBy("doc_id").agg(
        F.bround(F.sum(F.col("category_score") * F.col("weight")) / F.sum("weight")).cast("int").alias("score"))


def insights(scored_rows: DataFrame, related: int | None = None) -> DataFrame:
    """One row per insight, all from one array of the scored row. ``related`` limits the rules named with a weakness."""
    def rules(category: Column) -> Column:
        own = F.transform(F.filter("issues", lambda i: i["category"] == category), lambda i: rule_of(i["code"]))
        return F.array_join(own if related is None else F.slice(own, 1, related), ",")

    def insight(kind: str, category: Column, title: Column, impact: str, named: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), category.alias("category"), title.alias("title"), F.lit(impact).alias("impact"), named.alias("related_rules"))

    def judged(e: Column) -> Column:
        name = F.initcap(e["key"])
        return (F.when(e["value"] >= 80, insight("strength", e["key"], F.concat(F.lit("Strong "), name, F.lit(" Quality")), "low", F.lit("")))
                .when(e["value"] < 60, insight("weakness", e["key"], F.concat(name, F.lit(" Needs Attention")), "high", rules(e["key"]))))

    fixes = F.when(F.col("n_fixable") > 0, insight(
        "opportunity", F.lit("general"), F.concat(F.col("n_fixable").cast("string"), F.lit(" Issues Can Be Auto-Fixed")), "high", F.lit("")))
    found = F.array_compact(F.concat(F.transform(F.map_entries("category_scores"), judged), F.array(fixes)))
    return scored_rows.select("doc_id", F.explode_outer(found).alias("x")).where("x IS NOT NULL").select("doc_id", "x.*")


def severity_rank(severity: Column) -> Column:
    return (F.when(severity == "critical", F.lit(0)).when(severity == "high", F.lit(1))
            .when(severity == "medium", F.lit(2)).otherwise(F.lit(3)))


def gain(severity: Column) -> Column:
    return (F.when(severity == "critical", F.lit(15)).when(severity == "high", F.lit(10))
            .when(severity == "medium", F.lit(5)).otherwise(F.lit(2)))


def recommendations(scored_rows: DataFrame, top: int | None = None) -> DataFrame:
    """Issues ranked by severity, stable; the sort runs inside each document's row."""
    keyed = F.array_sort(F.transform("issues", lambda i, n: F.struct(
        severity_rank(i["severity"]).alias("rank"), n.alias("seq"), i.alias("i"))))
    ranked = keyed if top is None else F.slice(keyed, 1, top)
    rows = scored_rows.select("doc_id", F.posexplode_outer(ranked).alias("pos", "r")).where("r IS NOT NULL").select(
        "doc_id", (F.col("pos") + 1).alias("priority"), F.col("r.i").alias("issue"))
    return rendered(rows).select(
        "doc_id", "priority", "rule_id", "category", "severity", "message", "recommendation",
        F.col("autofix_allowed").alias("auto_fixable"), gain(F.col("severity")).alias("estimated_gain"))


def issue_summary(issues: DataFrame, *keys: str) -> DataFrame:
    """Counts per group and dimension, one pass with grouping sets."""
    dims = ["severity", "category", "source"]
    sets = [[*keys, d] for d in dims]
    grouped = issues.groupingSets(
        [[F.col(c) for c in s] for s in sets], *keys, *dims
    ).agg(F.count("*").alias("n"), F.count_if("autofix_allowed").alias("n_fixable"),
          *[F.grouping(d).alias(f"_{d}") for d in dims])
    kind = F.when(F.col("_severity") == 0, F.lit("severity")).when(F.col("_category") == 0, F.lit("category")).otherwise(
        F.lit("source"))
    value = F.when(F.col("_severity") == 0, F.col("severity")).when(
        F.col("_category") == 0, F.col("category")).otherwise(F.col("source"))
    return grouped.select(*keys, kind.alias("dimension"), value.alias("value"), "n", "n_fixable")


def next_steps(scored_rows: DataFrame) -> DataFrame:
    """Text steps in order, one row each."""
    entries = F.map_entries("category_scores")
    weakest = F.element_at(
        F.array_sort(F.transform(entries, lambda e, i: F.struct(
            e["value"].alias("points"), i.alias("i"), e["key"].alias("name")))), 1)
    steps = F.array_compact(F.array(
        F.when(F.col("n_severe") > 0, F.concat(
            F.lit("Fix "), F.col("n_severe").cast("string"), F.lit(" critical/high severity issues first"))),
        F.when(F.col("n_fixable") > 0, F.concat(
            F.lit("Apply "), F.col("n_fixable").cast("string"),
            F.lit(" available auto-fixes to quickly improve your score"))),
        F.when(weakest["points"] < 70, F.concat(
            F.lit("Focus on improving "), weakest["name"], F.lit(" quality (current: "),
            weakest["points"].cast("string"), F.lit("/100)"))),
        F.when(F.col("score") >= 85, F.lit(
            "Your document is nearly ready. Review remaining issues and submit when satisfied.")),
    ))
    return scored_rows.select("doc_id", F.posexplode(steps).alias("pos", "step")).select(
        "doc_id", (F.col("pos") + 1).alias("position"), "step")


def rule_distribution(issues: DataFrame) -> DataFrame:
    """Count per rule and its share of the most frequent rule (one row per rule, of a fixed catalogue, reaches the window)."""
    counts = issues.groupBy("rule_id").agg(F.count("*").alias("n"))
    return counts.select("rule_id", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6).alias("share_of_max"))


def top_by_confidence(issues: DataFrame, n: int = 5) -> DataFrame:
    """Per document, inside the row when given arrays; here over the issue table with a group limit."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "seq")
    return issues.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def effort(scored_rows: DataFrame) -> DataFrame:
    """Categories weakest first with gap-based impact and a time estimate per document."""
    todo = F.floor((F.lit(95) - F.col("score")) * (F.col("n_issues") / F.greatest(F.col("score"), F.lit(1))) * 0.6 + 0.5)
    minutes = F.greatest(F.lit(5), F.floor(todo * 2.5 + 0.5)).cast("int")
    ordered = F.array_sort(F.transform(F.map_entries("category_scores"), lambda e, i: F.struct(
        e["value"].alias("points"), i.alias("i"), e["key"].alias("category"))))
    return scored_rows.select("doc_id", minutes.alias("minutes"), F.posexplode(ordered).alias("pos", "c")).select(
        "doc_id", (F.col("pos") + 1).alias("position"), "c.category", F.col("c.points").alias("category_score"),
        F.when(F.col("c.points") < 60, F.lit("high")).when(F.col("c.points") < 80, F.lit("medium"))
        .otherwise(F.lit("low")).alias("priority"),
        F.floor((F.lit(95) - F.col("c.points")) / 5 + 0.5).cast("int").alias("impact"), "minutes")


def rule_statistics(issues: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hits and documents per rule; rules that never fired show zero."""
    hits = issues.groupBy("rule_id", "doc_id").agg(F.count("*").alias("n")).groupBy("rule_id").agg(
        F.sum("n").alias("n_issues"), F.count("*").alias("n_docs"))
    return catalog.select("rule_id", "category").join(hits, "rule_id", "left").select(
        "rule_id", "category", F.coalesce("n_issues", F.lit(0)).alias("n_issues"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
