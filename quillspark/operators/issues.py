"""Unified issues, duplicates, dependencies, priority; document graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import profiles as P
from ..functions.findings import rendered
from .score import gain, severity_rank


def unify(issues: DataFrame) -> DataFrame:
    """Unified category, source, severity, fix capability and confidence."""
    sources = F.create_map(*[F.lit(x) for pair in P.UNIFIED_SOURCES.items() for x in pair])
    category = F.lower("category")
    return issues.withColumns({
        "category": F.when(category.isin(P.UNIFIED_CATEGORIES), category).otherwise(F.lit("writing")),
        "source": F.coalesce(sources[F.lower("source")], F.lit("rule")),
        "severity": F.when(F.lower("severity").isin(list(P.SEVERITY_RANK)), F.lower("severity")).otherwise(F.lit("medium")),
        "fix_capability": F.when(F.col("autofix_allowed"), F.lit("assisted")).otherwise(F.lit("manual")),
        "confidence_ratio": F.when(F.col("confidence") > 1, F.col("confidence") / 100.0).otherwise(
            F.col("confidence").cast("double")),
    })


def deduplicate(issues: DataFrame) -> DataFrame:
    """First issue per (document, rule, line). An aggregate, so copies fold before the shuffle."""
    rest = [c for c in issues.columns if c not in ("doc_id", "rule_id", "line_start")]
    first = issues.groupBy("doc_id", "rule_id", "line_start").agg(
        F.min_by(F.struct(*rest), "seq").alias("kept"), F.count("*").alias("copies"))
    return first.select("doc_id", "rule_id", "line_start", "kept.*", (F.col("copies") - 1).alias("duplicates"))


def dependencies(issues: DataFrame) -> DataFrame:
    """Number and ids of the issues that follow from a heading or figure issue.

    The ids of one side are gathered per document first, so no pairs are built.
    """
    rule = F.lower("rule_id")
    caption, figure = rule.contains("caption"), rule.contains("figure")
    targets = issues.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(rule.contains("toc"), F.col("issue_id")))).alias("toc"),
        F.array_sort(F.collect_list(F.when(caption, F.col("issue_id")))).alias("captions"))
    heads = issues.where(rule.contains("heading") | (figure & ~caption)).select(
        "doc_id", "seq", "issue_id", rule.contains("heading").alias("is_heading"), (figure & ~caption).alias("is_figure"))
    empty = F.array().cast("array<string>")
    return heads.join(targets, "doc_id").select(
        "doc_id", "seq", "issue_id",
        F.concat(F.when(F.col("is_heading"), F.col("toc")).otherwise(empty),
                 F.when(F.col("is_figure"), F.col("captions")).otherwise(empty)).alias("followers"))


def prioritized(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Severity, then fix ease, stable; the sort stays inside the document row."""
    keyed = F.array_sort(F.transform("issues", lambda i, n: F.struct(
        severity_rank(i["severity"]).alias("rank"), F.when(i["fix"], F.lit(1)).otherwise(F.lit(3)).alias("ease"), n.alias("seq"), i.alias("i"))))
    ranked = keyed if top is None else F.slice(keyed, 1, top)
    rows = scored.select("doc_id", F.posexplode_outer(ranked).alias("pos", "r")).where("r IS NOT NULL").select(
        "doc_id", (F.col("pos") + 1).alias("priority"), "r.seq", F.col("r.i").alias("issue"))
    return rendered(rows).select(
        "doc_id", "priority", "seq", "rule_id", "category", "severity", "message", "recommendation", F.col("autofix_allowed").alias("auto_fixable"),
        gain(F.col("severity")).alias("score_gain"))


def summary(unified: DataFrame) -> DataFrame:
    """Totals per document, one aggregate."""
    one = lambda cond: F.count_if(cond)
    return unified.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        *[one(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")],
        one(F.col("fix_capability").isin("safe", "assisted")).alias("auto_fixable"),
        one(F.col("fix_capability") == "manual").alias("manual_review"),
        *[one(F.col("category") == c).alias(f"in_{c}") for c in P.UNIFIED_CATEGORIES],
        *[one(F.col("source") == s).alias(f"from_{s}") for s in ("rule", "ai", "cross_rule", "compliance")])


def strict_readiness(score: Column, critical: Column) -> Column:
    """Any critical issue keeps a document a draft."""
    return (F.when((critical > 0) | (score < 50), F.lit("draft")).when(score < 70, F.lit("review_needed"))
            .when(score < 85, F.lit("almost_ready")).otherwise(F.lit("ready")))


# --- document graph: nodes(doc_id, node_id, kind), edges(doc_id, src, dst, relation) -------


def neighbours(edges: DataFrame, outward: bool = True, relation: str | None = None) -> DataFrame:
    """Children (or parents) per node with an optional relation filter."""
    chosen = edges if relation is None else edges.where(F.col("relation") == relation)
    own, other = ("src", "dst") if outward else ("dst", "src")
    return chosen.select("doc_id", F.col(own).alias("node_id"), F.col(other).alias("neighbour"), "relation")


def without_edge(nodes: DataFrame, edges: DataFrame, kind: str, relation: str) -> DataFrame:
    """I09 (figure, mentions) and I10 (reference, cites): nodes no such edge points to."""
    targets = edges.where(F.col("relation") == relation).select("doc_id", F.col("dst").alias("node_id"))
    return nodes.where(F.col("kind") == kind).join(targets, ["doc_id", "node_id"], "left_anti").select(
        "doc_id", "node_id")


def document_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each document: caption figures with the lines that mention them, reference entries
    with the bracket numbers that cite them."""
    from ..fixed import words as W
    from ..functions import rx

    figures = F.array_distinct(F.transform(
        F.filter("captions", lambda c: F.lower(c["whole"]).startswith("fig") & c["number"].isNotNull()),
        lambda c: F.concat(F.lit("figure-"), c["number"].cast("string"))))
    entries = F.transform("refs", lambda r, i: F.concat(F.lit("reference-"), (i + 1).cast("string")))
    plain = F.filter("lines", lambda l: ~l.rlike(rx.fold("^" + W.CAPTION)))
    mentioned = F.transform(
        F.flatten(F.transform(plain, lambda l: rx.find_all(l, rx.fold(W.FIGURE_REF), 1))),
        lambda n: F.concat(F.lit("figure-"), n))
    cited = F.transform(
        rx.find_all(F.col("text"), rx.exact(W.ACM_BRACKET), 1), lambda n: F.concat(F.lit("reference-"), n))
    made = parsed.select(
        "doc_id", figures.alias("figures"), entries.alias("entries"), F.array_distinct(mentioned).alias("mentioned"),
        F.array_distinct(cited).alias("cited"))
    nodes = made.select("doc_id", F.explode_outer(F.concat(
        F.transform("figures", lambda n: F.struct(n.alias("node_id"), F.lit("figure").alias("kind"))),
        F.transform("entries", lambda n: F.struct(n.alias("node_id"), F.lit("reference").alias("kind"))))).alias("x")
    ).where("x IS NOT NULL").select("doc_id", "x.*")
    edges = made.select("doc_id", F.explode_outer(F.concat(
        F.transform("mentioned", lambda n: F.struct(
            F.lit("body").alias("src"), n.alias("dst"), F.lit("mentions").alias("relation"))),
        F.transform("cited", lambda n: F.struct(
            F.lit("body").alias("src"), n.alias("dst"), F.lit("cites").alias("relation"))))).alias("x")
    ).where("x IS NOT NULL").select("doc_id", "x.*")
    return nodes, edges
