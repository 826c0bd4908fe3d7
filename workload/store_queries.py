"""Issues, scores, fixes, safety, store and operations queries with their oracles."""

from __future__ import annotations

import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from quillspark.fixed.catalog import ISSUES
from quillspark.fixed import fixes as X, profiles as P, words as W
from quillspark.functions import rx
from quillspark.functions.findings import category_of
from quillspark.operators import config as C, document as DOC, fix as FX, issues as I, ops as O, report as R, safety as L, score as G
from quillspark.operators.parse import parse
from quillspark.operators.rules import META, REGISTRY, rule, tables
from quillspark.operators.rules.tables import TableRule, stock_issue, table_rule
from quillspark.plans import store as S
from quillspark.plans.review import all_issues, issue_rows, review_rows
from quillspark.session import shared_dir
from quillspark.sources import files as SF, store as SS
from quillspark.streaming import jobs

from .blocks import BLOCKS_SQL, blocks
from .drafts import PROFILE_CYCLE, RAW_SQL, documents, drafts, pick, sql_pick
from .rule_oracles import all_rules
from .sql import any_in, base, count_in, found, has, n, q, strip, words

Q: dict[str, tuple] = {}

# --- the reviewed drafts: every rule a stock profile reaches, with stock thresholds --------------
# two rules have no effect under a stock profile: one needs a pack, one is off
_STOCK = {r: sql.replace("mean * 3", "mean * 10") for r, sql in all_rules().items() if r in REGISTRY and META[r][0] not in ("format", "figure_table")
          and r not in ("compliance.mandatory-sections", "logic.unsupported-conclusion")}
RULESET = list(_STOCK)
_CATS = ", ".join(f"({q(p[0])}, {q(c)}, {w}, {i})" for p in P.PROFILES for i, (c, w) in enumerate(p[2].items()))
_META = ", ".join(f"({q(r)}, {q(META[r][0])}, {META[r][1]})" for r in RULESET)
_ISS = base() + f""", cats AS (SELECT * FROM (VALUES {_CATS}) t(profile_id, category, weight, pos)),
iss AS MATERIALIZED (SELECT i.* EXCLUDE (priority, registered), d.profile_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY i.priority DESC, i.registered, i.line_start, i.issue_id) - 1 AS seq
  FROM ({' UNION ALL '.join(f"(SELECT *, {q(META[r][0])} AS category, {META[r][1]} AS priority, {q(r)} AS registered FROM ({_STOCK[r]}))" for r in RULESET)}) i
  JOIN docs d USING (doc_id) JOIN cats c ON c.profile_id = d.profile_id AND c.category = i.category),
cat_scores AS (SELECT d.doc_id, c.category, c.weight, c.pos, {{scores}} FROM docs d JOIN cats c USING (profile_id)),
per_doc AS (SELECT doc_id, count(*) AS n_issues, count(*) FILTER (WHERE severity = 'high') AS n_severe, count(*) FILTER (WHERE autofix_allowed) AS n_fixable FROM iss GROUP BY doc_id),
totals AS (SELECT s.doc_id, CAST(round_even(sum(points * weight) / sum(weight), 0) AS INTEGER) AS score, coalesce(any_value(n_issues), 0) AS n_issues, coalesce(any_value(n_severe), 0) AS n_severe,
  coalesce(any_value(n_fixable), 0) AS n_fixable FROM cat_scores s LEFT JOIN per_doc p USING (doc_id) GROUP BY s.doc_id),
ready AS (SELECT *, CASE WHEN n_severe > 5 OR score < 50 THEN 'draft' WHEN score < 70 THEN 'review_needed' WHEN score < 85 THEN 'almost_ready' ELSE 'ready' END AS readiness FROM totals)
"""


def iss(mode: str = "standard") -> str:
    lost = {k: round(v * P.SCORING_MODES[mode]) for k, v in P.DEDUCTIONS.items()}
    deduct = (f"greatest(0, 100 - coalesce((SELECT sum(CASE severity WHEN 'high' THEN {lost['high']} WHEN 'medium' THEN {lost['medium']} ELSE {lost['low']} END) "
              "FROM iss i WHERE i.doc_id = d.doc_id AND i.category = c.category), 0)) AS points")
    return _ISS.replace("{scores}", deduct)


def reviewed(s, d):
    return review_rows(drafts(s, d), rule_ids=RULESET)


def scored(s, d, mode="standard"):
    return G.scored(reviewed(s, d), mode)


def issue_table(s, d, *keep):
    return issue_rows(reviewed(s, d), *keep)


# the whole engine on the raw documents
_WHOLE = base("raw_docs") + f""", cats AS (SELECT * FROM (VALUES {_CATS}) t(profile_id, category, weight, pos)),
iss AS MATERIALIZED (SELECT i.doc_id, i.category, i.severity, i.fix FROM ({' UNION ALL '.join(f"SELECT doc_id, {q(META[r][0])} AS category, severity, autofix_allowed AS fix FROM ({sql})" for r, sql in _STOCK.items())}) i
  JOIN docs d USING (doc_id) JOIN cats c ON c.profile_id = d.profile_id AND c.category = i.category),
lost AS (SELECT doc_id, category, sum(CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 4 END) AS lost FROM iss GROUP BY ALL),
per_doc AS (SELECT doc_id, count(*) AS n_issues, count(*) FILTER (WHERE severity = 'high') AS n_severe, count(*) FILTER (WHERE fix) AS n_fixable FROM iss GROUP BY doc_id),
tot AS (SELECT d.doc_id, d.profile_id, CAST(round_even(sum(greatest(0, 100 - coalesce(l.lost, 0)) * c.weight) / sum(c.weight), 0) AS INTEGER) AS score FROM docs d JOIN cats c USING (profile_id)
  LEFT JOIN lost l ON l.doc_id = d.doc_id AND l.category = c.category GROUP BY ALL)
SELECT doc_id, profile_id, score, CASE WHEN coalesce(n_severe, 0) > 5 OR score < 50 THEN 'draft' WHEN score < 70 THEN 'review_needed' WHEN score < 85 THEN 'almost_ready' ELSE 'ready' END AS readiness,
  coalesce(n_issues, 0) AS n_issues, coalesce(n_severe, 0) AS n_severe, coalesce(n_fixable, 0) AS n_fixable FROM tot LEFT JOIN per_doc USING (doc_id)"""
Q["review_documents"] = (
    lambda s, d: G.scored(review_rows(documents(s, d))).select("doc_id", "profile_id", "score", "readiness", "n_issues", "n_severe", "n_fixable"), _WHOLE)
_EVERY = {r: sql for r, sql in all_rules().items() if r in REGISTRY and r not in ("compliance.mandatory-sections", "logic.unsupported-conclusion")}
_stock = lambda sql: sql.replace("mean * 3", "mean * 10").replace("w > 400", "w > 2000").replace("(max: 400)", "(max: 2000)")
Q["review_drafts"] = (
    lambda s, d: issue_rows(review_rows(drafts(s, d), formatting_alias=True)).select(
        "doc_id", "issue_id", "category", "rule_id", "severity", "message", "line_start", "line_end", "confidence", "autofix_allowed"),
    base() + BLOCKS_SQL.replace("FROM lines WHERE bare <> ''", "FROM lines WHERE FALSE") + f""", cats AS (SELECT * FROM (VALUES {_CATS}) t(profile_id, category, weight, pos)),
    iss AS MATERIALIZED ({' UNION ALL '.join(f"SELECT doc_id, issue_id, {q(META[r][0])} AS category, rule_id, severity, message, line_start, line_end, confidence, autofix_allowed FROM ({_stock(sql)})" for r, sql in _EVERY.items())})
    SELECT i.* FROM iss i JOIN docs d USING (doc_id) JOIN cats c ON c.profile_id = d.profile_id AND c.category = CASE WHEN i.category IN ('format', 'figure_table') THEN 'formatting' ELSE i.category END""")
Q["rule_statistics"] = (
    lambda s, d: G.rule_statistics(issue_table(s, d), C.rule_table(s).where(F.col("rule_id").isin(RULESET))),
    iss() + f"SELECT m.rule_id, m.category, count(i.doc_id) AS n_issues, count(DISTINCT i.doc_id) AS n_docs FROM (VALUES {_META}) m(rule_id, category, priority) LEFT JOIN iss i USING (rule_id) GROUP BY 1, 2")

# one rule and one category with another severity, one rule and one category off, another confidence
Q["c08_overridden_review"] = (
    lambda s, d: issue_rows(review_rows(drafts(s, d), rule_ids=RULESET, disabled=("writing.spelling", "compliance"), severities={"writing.grammar": "high", "writing": "low", "structure": "low"}),
                            confidences={"writing.grammar": 11, "citation": 22}).select("doc_id", "issue_id", "rule_id", "severity", "confidence"),
    iss() + """SELECT doc_id, issue_id, rule_id, CASE WHEN rule_id = 'writing.grammar' THEN 'high' WHEN category IN ('writing', 'structure') THEN 'low' ELSE severity END AS severity,
    CASE WHEN rule_id = 'writing.grammar' THEN 11 WHEN category = 'citation' THEN 22 ELSE confidence END AS confidence FROM iss WHERE rule_id <> 'writing.spelling' AND category <> 'compliance'""")


@rule("structure.long-title", "structure", 5, enabled=False)
def long_title(d, cfg):
    """A user's own rule over the same document columns: it reuses a stock issue text."""
    from quillspark.functions.findings import issue
    return F.transform(F.filter(d.headings, lambda h: F.length(h["title"]) > 25),
                       lambda h: issue("title-not-h1", line=h["line_no"], level=h["level"], title=h["title"]))


Q["u01_registered_rule"] = (
    lambda s, d: issue_rows(review_rows(drafts(s, d), rule_ids=["structure.long-title"])).select("doc_id", "issue_id", "line_start"),
    base() + "SELECT doc_id, 'structure.title-not-h1' AS issue_id, line_no AS line_start FROM heads WHERE length(title) > 25")



@table_rule("structure.long-title")
class LongTitles(TableRule):
    """The same rule as a table function over lines."""

    def line(self, number, text):
        from quillspark.fixed.words import HEADING

        found = re.match(HEADING, text)
        if found and len(found[2]) > 25:
            yield stock_issue("title-not-h1", number, level=len(found[1]), title=found[2])


_LONG = base() + "SELECT * , 'structure' AS category, 'syntax-rule' AS source FROM (" + found("title-not-h1", "heads", "length(title) > 25", line="line_no", level="level", title="title") + ")"
Q["u04_table_rule"] = (lambda s, d: tables.issue_table(DOC.line_rows(parse(drafts(s, d))), "structure.long-title"), _LONG)


def lateral_rule(s, d):
    """The lateral form through SQL."""
    _, name = tables.register(s, "structure.long-title")
    return s.sql(f"SELECT d.doc_id, t.* FROM {{docs}} d, LATERAL {name}(d.lines) t", docs=parse(drafts(s, d)).select("doc_id", "lines"))


Q["u04_lateral_rule"] = (lateral_rule, _LONG)

# --- I -----------------------------------------------------------------------------------
Q["i01_unified_issues"] = (
    lambda s, d: I.unify(issue_table(s, d)).groupBy("category", "source", "severity", "fix_capability").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence_ratio"), 6).alias("confidence")),
    iss() + """SELECT category, 'rule' AS source, severity, CASE WHEN autofix_allowed THEN 'assisted' ELSE 'manual' END AS fix_capability, count(*) AS n, round(avg(confidence / 100.0), 6) AS confidence FROM iss GROUP BY 1, 2, 3, 4""")
Q["i02_deduplicated"] = (
    lambda s, d: I.deduplicate(issue_table(s, d)).select("doc_id", "rule_id", "line_start", "duplicates"),
    iss() + "SELECT doc_id, rule_id, line_start, count(*) - 1 AS duplicates FROM iss GROUP BY doc_id, rule_id, line_start")
_HEADRULES = ["structure.heading-hierarchy", "figure.cross-reference", "figure.caption-format"]


def dependency_issues(s, d):
    return issue_rows(parse(C.attach_profile(drafts(s, d))).withColumn("issues", all_issues(
        parse(C.attach_profile(drafts(s, d))), rule_ids=_HEADRULES, categories=None)))


Q["i03_dependencies"] = (
    lambda s, d: I.dependencies(dependency_issues(s, d)).select("doc_id", "issue_id", F.array_join("followers", ",").alias("followers")),
    base() + BLOCKS_SQL.replace("FROM lines WHERE bare <> ''", "FROM lines WHERE FALSE") + f""", i AS ({' UNION ALL '.join('(' + all_rules()[r] + ')' for r in _HEADRULES)}),
    c AS (SELECT doc_id, string_agg(issue_id, ',' ORDER BY issue_id) AS f FROM i WHERE contains(rule_id, 'caption') GROUP BY doc_id)
    SELECT i.doc_id, i.issue_id, CASE WHEN contains(rule_id, 'figure') THEN coalesce(c.f, '') ELSE '' END AS followers FROM i LEFT JOIN c USING (doc_id) WHERE NOT contains(rule_id, 'caption')""")
_RANK = "CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_PRI = f"row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, CASE WHEN autofix_allowed THEN 1 ELSE 3 END, seq)"
_GAIN = "CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END"
# seq differs where two issues of one rule share a line, so positions compare by severity and fix ease
Q["i04_prioritized"] = (
    lambda s, d: I.prioritized(reviewed(s, d)).select("doc_id", "priority", "rule_id", "severity", "auto_fixable"),
    iss() + f"SELECT doc_id, {_PRI} AS priority, rule_id, severity, autofix_allowed AS auto_fixable FROM iss")
Q["i05_summary"] = (
    lambda s, d: I.summary(I.unify(issue_table(s, d))),
    iss() + "SELECT doc_id, count(*) AS total, 0 AS critical, " + ", ".join(f"count(*) FILTER (WHERE severity = '{v}') AS {v}" for v in ("high", "medium", "low"))
    + ", count(*) FILTER (WHERE autofix_allowed) AS auto_fixable, count(*) FILTER (WHERE NOT autofix_allowed) AS manual_review, "
    + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS in_{c}" for c in P.UNIFIED_CATEGORIES)
    + ", count(*) AS from_rule, 0 AS from_ai, 0 AS from_cross_rule, 0 AS from_compliance FROM iss GROUP BY doc_id")
Q["i06_strict_readiness"] = (
    lambda s, d: scored(s, d).select("doc_id", I.strict_readiness(F.col("score"), F.size(F.filter("issues", lambda i: i["severity"] == "critical"))).alias("readiness")),
    iss() + "SELECT doc_id, CASE WHEN score < 50 OR doc_id IN (SELECT doc_id FROM iss WHERE severity = 'critical') THEN 'draft' WHEN score < 70 THEN 'review_needed' WHEN score < 85 THEN 'almost_ready' ELSE 'ready' END AS readiness FROM totals")
Q["i07_top_recommendations"] = (
    lambda s, d: I.prioritized(reviewed(s, d), top=5).select("doc_id", "priority", "rule_id", "severity", "auto_fixable", "score_gain"),
    iss() + f"SELECT * FROM (SELECT doc_id, {_PRI} AS priority, rule_id, severity, autofix_allowed AS auto_fixable, {_GAIN} AS score_gain FROM iss) WHERE priority <= 5")
_NODES = base() + f""", fig AS (SELECT DISTINCT doc_id, 'figure-' || number AS node_id FROM caps WHERE number IS NOT NULL AND starts_with(lower(whole), 'fig')),
nref2 AS (SELECT doc_id, 'reference-' || (pos + 1) AS node_id FROM refs),
men AS (SELECT DISTINCT doc_id, 'figure-' || unnest(regexp_extract_all(line, {q('(?i)' + W.FIGURE_REF)}, 1)) AS node_id FROM lines WHERE NOT {has('line', '^' + W.CAPTION, 'i')}),
cit AS (SELECT DISTINCT doc_id, 'reference-' || unnest(regexp_extract_all(text, {q(W.ACM_BRACKET)}, 1)) AS node_id FROM docs)
"""


def graph(s, d):
    return I.document_graph(parse(drafts(s, d)))


Q["i08_graph_neighbours"] = (
    lambda s, d: I.neighbours(graph(s, d)[1], relation="mentions").select("doc_id", "node_id", "neighbour"),
    _NODES + "SELECT doc_id, 'body' AS node_id, node_id AS neighbour FROM men")
Q["i08_graph_parents"] = (
    lambda s, d: I.neighbours(graph(s, d)[1], outward=False).select("doc_id", "node_id", "neighbour", "relation"),
    _NODES + "SELECT doc_id, node_id, 'body' AS neighbour, 'mentions' AS relation FROM men UNION ALL SELECT doc_id, node_id, 'body', 'cites' FROM cit")
Q["i09_orphan_figures"] = (
    lambda s, d: I.without_edge(*graph(s, d), "figure", "mentions"),
    _NODES + "SELECT * FROM fig ANTI JOIN men USING (doc_id, node_id)")
Q["i10_uncited_references"] = (
    lambda s, d: I.without_edge(*graph(s, d), "reference", "cites"),
    _NODES + "SELECT * FROM nref2 ANTI JOIN cit USING (doc_id, node_id)")

# --- G -----------------------------------------------------------------------------------
Q["g01_category_scores"] = (
    lambda s, d: scored(s, d).select("doc_id", F.explode_outer("category_scores").alias("category", "points")),
    iss() + "SELECT doc_id, category, points FROM cat_scores")
for _mode in ("standard", "strict", "relaxed"):
    Q[f"g02_overall_score_{_mode}"] = (
        lambda s, d, m=_mode: scored(s, d, m).select("doc_id", "score"), iss(_mode) + "SELECT doc_id, score FROM totals")
Q["g02_score_from_tables"] = (
    lambda s, d: G.score_issue_table(C.attach_profile(drafts(s, d)).select("doc_id", "weights"), issue_table(s, d)),
    iss() + "SELECT doc_id, score FROM totals")
Q["g03_readiness"] = (
    lambda s, d: scored(s, d).select("doc_id", "readiness", "improvement_potential"),
    iss() + "SELECT doc_id, readiness, least(n_fixable * 5, 30) AS improvement_potential FROM ready")
_TC = "upper(category[1]) || category[2:]"
Q["g04_insights"] = (
    lambda s, d: G.insights(scored(s, d)),
    iss() + f"""SELECT doc_id, CASE WHEN points >= 80 THEN 'strength' ELSE 'weakness' END AS type, category, CASE WHEN points >= 80 THEN 'Strong ' || {_TC} || ' Quality' ELSE {_TC} || ' Needs Attention' END AS title,
    CASE WHEN points >= 80 THEN 'low' ELSE 'high' END AS impact,
    CASE WHEN points >= 80 THEN '' ELSE (SELECT string_agg(rule_id, ',' ORDER BY seq) FROM iss i WHERE i.doc_id = c.doc_id AND i.category = c.category) END AS related_rules FROM cat_scores c WHERE points >= 80 OR points < 60
    UNION ALL SELECT doc_id, 'opportunity', 'general', n_fixable || ' Issues Can Be Auto-Fixed', 'high', '' FROM totals WHERE n_fixable > 0""")
Q["g05_recommendations"] = (
    lambda s, d: G.recommendations(scored(s, d)).select("doc_id", "priority", "rule_id", "severity", "estimated_gain"),
    iss() + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, seq) AS priority, rule_id, severity, {_GAIN} AS estimated_gain FROM iss")
# an issue id starts with its template up to the first slot; the longest start tells the issue
_SOURCES = ", ".join(sorted({f"({q(v[1])}, {q(v[0].split('{')[0])}, {q(v[4])})" for v in ISSUES.values()}))
Q["g06_issue_summary"] = (
    lambda s, d: G.issue_summary(issue_table(s, d)),
    iss() + f"""SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE autofix_allowed) AS n_fixable FROM (SELECT 'severity' AS dimension, severity AS value, autofix_allowed FROM iss
    UNION ALL SELECT 'category', category, autofix_allowed FROM iss UNION ALL SELECT 'source', s.source, autofix_allowed FROM iss JOIN (SELECT doc_id, seq, arg_max(source, length(start)) AS source FROM iss i JOIN (VALUES {_SOURCES}) v(rule_id, start, source) ON v.rule_id = i.rule_id AND starts_with(i.issue_id, v.start) GROUP BY doc_id, seq) s USING (doc_id, seq)) GROUP BY ALL""")
Q["g07_next_steps"] = (
    lambda s, d: G.next_steps(scored(s, d)).select("doc_id", "step"),
    iss() + """SELECT doc_id, 'Fix ' || n_severe || ' critical/high severity issues first' AS step FROM totals WHERE n_severe > 0
    UNION ALL SELECT doc_id, 'Apply ' || n_fixable || ' available auto-fixes to quickly improve your score' FROM totals WHERE n_fixable > 0
    UNION ALL SELECT doc_id, 'Focus on improving ' || category || ' quality (current: ' || points || '/100)' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points, pos) AS rn FROM cat_scores) WHERE rn = 1 AND points < 70
    UNION ALL SELECT doc_id, 'Your document is nearly ready. Review remaining issues and submit when satisfied.' FROM totals WHERE score >= 85""")


def counted(s, d):
    """Scored reviews with the tables and figures of their documents."""
    stats = DOC.document_stats(parse(drafts(s, d)), blocks(s, d)).select("doc_id", "tables", "figures")
    return scored(s, d).join(stats, "doc_id")


Q["g08_report"] = (lambda s, d: R.report(counted(s, d)), None)
Q["g08_report_vi"] = (lambda s, d: R.report(counted(s, d), "vi"), None)
Q["g09_rule_distribution"] = (
    lambda s, d: G.rule_distribution(issue_table(s, d)),
    iss() + "SELECT rule_id, count(*) AS n, round(count(*) / (max(count(*)) OVER ())::DOUBLE, 6) AS share_of_max FROM iss GROUP BY rule_id")
Q["g10_top_confidence"] = (
    lambda s, d: G.top_by_confidence(issue_table(s, d)).select("doc_id", "rank", "rule_id", "confidence"),
    iss() + "SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, seq) AS rank, rule_id, confidence FROM iss) WHERE rank <= 5")
Q["g11_effort"] = (
    lambda s, d: G.effort(scored(s, d)),
    iss() + """SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY points, pos) AS position, category, points AS category_score, CASE WHEN points < 60 THEN 'high' WHEN points < 80 THEN 'medium' ELSE 'low' END AS priority,
    CAST(floor((95 - points) / 5.0 + 0.5) AS INTEGER) AS impact, CAST(greatest(5, floor(floor((95 - score) * (n_issues / greatest(score, 1)::DOUBLE) * 0.6::DOUBLE + 0.5) * 2.5 + 0.5)) AS INTEGER) AS minutes FROM cat_scores c JOIN totals t USING (doc_id)""")
# --- P20-P22 over the reviewed drafts -----------------------------------------------------
_J = lambda a, b: f"array_to_string(d.ls[{a}:{b}], chr(10))"
Q["p20_snippets"] = (
    lambda s, d: DOC.issue_snippets(reviewed(s, d)).select("doc_id", "line_start", "highlighted", "before", "after"),
    iss() + f"""SELECT doc_id, line_start, CASE WHEN length(h) > 500 THEN left(h, 500) || '...' ELSE h END AS highlighted, CASE WHEN length(b) > 200 THEN '...' || right(b, 200) ELSE b END AS before,
    CASE WHEN length(a) > 200 THEN left(a, 200) || '...' ELSE a END AS after FROM (SELECT i.doc_id, i.line_start, {_J('i.line_start', 'i.line_end')} AS h, CASE WHEN i.line_start = 1 THEN '' ELSE {_J('greatest(1, i.line_start - 2)', 'i.line_start - 1')} END AS b,
    CASE WHEN i.line_end >= d.n_lines THEN '' ELSE {_J('i.line_end + 1', 'i.line_end + 2')} END AS a FROM iss i JOIN docs d USING (doc_id))""")
Q["p20_multi_range_snippets"] = (
    lambda s, d: DOC.category_snippets(reviewed(s, d)),
    iss() + f""", r AS (SELECT DISTINCT i.doc_id, i.category, i.line_start AS a, i.line_end AS b FROM iss i)
    SELECT r.doc_id, category, string_agg({_J('r.a', 'r.b')}, chr(10) || '...' || chr(10) ORDER BY r.a, r.b) AS highlighted, CASE WHEN min(r.a) = 1 THEN '' ELSE any_value(d.ls[least(min_a - 1, d.n_lines)]) END AS before,
    coalesce(any_value(d.ls[last_b + 1]), '') AS after FROM (SELECT *, min(a) OVER w AS min_a, last_value(b) OVER (w ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_b FROM r WINDOW w AS (PARTITION BY doc_id, category)) r
    JOIN docs d USING (doc_id) GROUP BY r.doc_id, category""")
Q["p21_jump_targets"] = (
    lambda s, d: DOC.jump_targets(issue_table(s, d), blocks(s, d)).select("doc_id", "block_idx", "page_number", "node_id", "target_start", "target_end"),
    iss() + BLOCKS_SQL + """SELECT i.doc_id, b.block_idx, b.page_number, b.node_id, b.line_start AS target_start, b.line_end AS target_end FROM iss i JOIN blk b ON b.doc_id = i.doc_id AND b.block_idx = i.line_start - 1
    UNION ALL SELECT i.doc_id, b.block_idx, b.page_number, b.node_id, i.line_start, i.line_end FROM iss i JOIN blk b ON b.doc_id = i.doc_id AND i.line_start BETWEEN b.line_start AND b.line_end
    WHERE NOT EXISTS (SELECT 1 FROM blk x WHERE x.doc_id = i.doc_id AND x.block_idx = i.line_start - 1)""")
Q["p22_evidence_blocks"] = (
    lambda s, d: DOC.evidence_blocks(issue_table(s, d), blocks(s, d)).select("doc_id", F.array_join("node_ids", ",").alias("nodes")),
    iss() + BLOCKS_SQL + """SELECT doc_id, nodes FROM (SELECT i.doc_id, i.seq, string_agg(DISTINCT b.node_id, ',' ORDER BY b.node_id) AS nodes FROM iss i JOIN blk b ON b.doc_id = i.doc_id AND (b.line_start BETWEEN i.line_start AND i.line_end OR b.line_end BETWEEN i.line_start AND i.line_end) GROUP BY ALL)""")

# --- F -----------------------------------------------------------------------------------


def line_texts(s, d):
    return DOC.line_rows(parse(drafts(s, d)))


def fixer(fn, sql):
    """One fixer over every draft line; the changed lines are the result."""
    return (lambda s, d: line_texts(s, d).select("doc_id", "line_no", "line", fn(F.col("line")).alias("fixed")).where("fixed <> line").select("doc_id", "line_no", "fixed"),
            base() + f"SELECT * FROM (SELECT doc_id, line_no, {sql} AS fixed, line FROM lines) WHERE fixed <> line".replace("SELECT * FROM", "SELECT doc_id, line_no, fixed FROM", 1))


def chain(x: str, pairs, flags: str = "i") -> str:
    for p, w in pairs:
        x = f"regexp_replace({x}, {q(f'(?{flags})' + p)}, {q(w)}, 'g')"
    return x


_B = strip("line")
Q["f03_heading_style"] = fixer(lambda c: FX.heading_style(F.regexp_replace(c, r"^(#+)\s+", "$1")), f"regexp_replace(line, '^(#+)\\s+([^#\\s])', '\\1 \\2')")
Q["f05_reference_format"] = fixer(FX.reference_format, "regexp_replace(line, '(?i)DOI:\\s*', 'doi:', 'g')")
Q["f06_url_prefix"] = fixer(FX.url_prefix, "replace(replace(replace(line, '://', chr(1)), '//', '://'), chr(1), '://')")
Q["f07_bullets"] = fixer(lambda c: FX.bullets(F.regexp_replace(c, "^[|] ", "* ")), "CASE WHEN starts_with(line, '| ') THEN '- ' || substr(regexp_replace(line, '\\s+$', ''), 3) ELSE line END")
Q["f08_period_spacing"] = fixer(FX.period_spacing, "replace(regexp_replace(line, '\\.([A-Z])', '. \\1', 'g'), '.  ', '. ')")
Q["f09_citation_order"] = fixer(lambda c: FX.citation_order(F.replace(c, F.lit("[1] and [2]"), F.lit("[7, 2,5]"))), "replace(replace(line, '[1] and [2]', '[7, 2,5]'), '[7, 2,5]', '[2], [5], [7]')")
#: Small letters whose capital is several characters (DuckDB's upper keeps one character), as Unicode lists them.
_LONG_CAPITALS = [(c, c.upper()) for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Ll" and len(c.upper()) > 1]
_FIRST = "left(lower(line), 1)"
_CAPITAL = f"coalesce(map([{', '.join(q(c) for c, _ in _LONG_CAPITALS)}], [{', '.join(q(u) for _, u in _LONG_CAPITALS)}])[{_FIRST}], upper({_FIRST}))"
Q["f10_bullet_capitals"] = fixer(lambda c: FX.bullet_capitals(F.concat(F.lit("- "), F.lower(c)), corrected=True),
                                 f"CASE WHEN regexp_matches(lower(line), '^\\p{{Ll}}') THEN '- ' || {_CAPITAL} || substr(lower(line), 2) ELSE '- ' || lower(line) END")
Q["f11_spelling"] = fixer(FX.spelling, chain("line", X.SPELLING_FIXES))
Q["f12_hedging"] = fixer(FX.hedging, chain("line", [(p if w else p + r"\s*", w or " ") for p, w in X.HEDGING_FIXES]))
Q["f04_line_spacing"] = (
    lambda s, d: drafts(s, d).select("doc_id", F.sha2(FX.line_spacing(F.replace("text", F.lit("\n\n"), F.lit("\n\n\n\n"))), 256).alias("digest")),
    base() + "SELECT doc_id, sha256(regexp_replace(replace(text, chr(10) || chr(10), chr(10) || chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM docs")
_SHORT = "string_split(replace(lower(rule_id), '_', '-'), '.')[-1]"
_HED = chain("excerpt", [(p if w else p + r"\s*", w or " ") for p, w in X.HEDGING_FIXES])
_SUG = iss() + f""", sug AS (SELECT doc_id, issue_id, rule_id, severity, category, excerpt AS original, line_start, line_end, confidence, CASE WHEN contains({_SHORT}, 'reference') THEN regexp_replace(excerpt, '(?i)DOI:\\s*', 'doi:', 'g') WHEN {_SHORT} = 'punctuation' THEN replace(regexp_replace(excerpt, '\\.([A-Z])', '. \\1', 'g'), '.  ', '. ')
      WHEN {_SHORT} = 'spelling' THEN {chain("excerpt", X.SPELLING_FIXES)} WHEN category = 'writing' AND contains({_SHORT}, 'passive') THEN excerpt WHEN category = 'writing' AND contains({_SHORT}, 'hedging') THEN {_HED} END AS suggested,
    CASE WHEN {_SHORT} IN ({', '.join(q(x) for x in X.SAFE_TYPE)}) THEN 'safe' WHEN {_SHORT} IN ({', '.join(q(x) for x in X.AI_TYPE)}) THEN 'ai' ELSE 'manual' END AS fix_type FROM iss WHERE autofix_allowed AND {strip('excerpt')} <> ''),
sug2 AS (SELECT *, sha256(concat_ws('|', doc_id, issue_id, rule_id, line_start, line_end, original, suggested)) AS id FROM sug WHERE suggested IS NOT NULL AND suggested <> original)
"""


def suggested(s, d):
    """Suggestions of all issues; rules without a fixer are left out of the review, as they give none."""
    return FX.suggestions(issue_rows(review_rows(drafts(s, d), rule_ids=[r for r in RULESET if FX.has_fixer(r, META[r][0])])))


Q["f01_suggestions"] = (
    lambda s, d: suggested(s, d).select("id", "doc_id", "issue_id", "original", "suggested", "line_start", "confidence", "fix_type"),
    _SUG + "SELECT id, doc_id, issue_id, original, suggested, line_start, confidence, fix_type FROM sug2")
Q["f02_fix_routing"] = (
    lambda s, d: issue_table(s, d).select("rule_id", FX.short_rule(F.col("rule_id")).alias("route")).distinct(),
    iss() + f"SELECT DISTINCT rule_id, {_SHORT} AS route FROM iss")
Q["f13_fix_type"] = (
    lambda s, d: issue_table(s, d).groupBy("rule_id", FX.fix_type(F.col("rule_id")).alias("fix_type")).agg(F.count("*").alias("n")),
    iss() + f"SELECT rule_id, CASE WHEN {_SHORT} IN ({', '.join(q(x) for x in X.SAFE_TYPE)}) THEN 'safe' WHEN {_SHORT} IN ({', '.join(q(x) for x in X.AI_TYPE)}) THEN 'ai' ELSE 'manual' END AS fix_type, count(*) AS n FROM iss GROUP BY ALL")
_CC = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.CATEGORY_CONFIDENCE.items())
_CONF = f"""conf AS (SELECT *, greatest(5, least(100, CASE severity WHEN 'high' THEN greatest(30, t - 5) WHEN 'low' THEN least(100, t + 3) ELSE t END)) AS fc FROM (SELECT *, CASE fix_type WHEN 'safe' THEN least(100, b + 5) WHEN 'ai' THEN greatest(20, b - 10) ELSE b END AS t
    FROM (SELECT *, CASE category {_CC} ELSE 60 END AS b FROM {{src}})))"""
_ALLS = iss() + f""", typed AS (SELECT *, CASE WHEN {_SHORT} IN ({', '.join(q(x) for x in X.SAFE_TYPE)}) THEN 'safe' WHEN {_SHORT} IN ({', '.join(q(x) for x in X.AI_TYPE)}) THEN 'ai' ELSE 'manual' END AS fix_type FROM iss), """ + _CONF.replace("{src}", "typed")
_fc = lambda: FX.fix_confidence(F.col("rule_id"), F.col("category"), FX.fix_type(F.col("rule_id")), F.col("severity"))
Q["f14_fix_confidence"] = (
    lambda s, d: issue_table(s, d).groupBy("rule_id", "severity", _fc().alias("fix_confidence")).agg(F.count("*").alias("n")),
    _ALLS + " SELECT rule_id, severity, fc AS fix_confidence, count(*) AS n FROM conf GROUP BY ALL")
Q["f15_confirm_level"] = (
    lambda s, d: issue_table(s, d).groupBy(FX.confirm_level(_fc()).alias("level"), FX.confidence_label(_fc()).alias("label")).agg(F.count("*").alias("n")),
    _ALLS + """ SELECT CASE WHEN fc >= 95 THEN 'safe' WHEN fc >= 60 THEN 'confirm' WHEN fc >= 30 THEN 'review' ELSE 'manual' END AS level,
    CASE WHEN fc >= 95 THEN '🟢 ' || fc || '% Safe' WHEN fc >= 80 THEN '🟢 ' || fc || '%' WHEN fc >= 60 THEN '🟡 ' || fc || '%' WHEN fc >= 40 THEN '🟠 ' || fc || '%' ELSE '🔴 Suggestion Only' END AS label, count(*) AS n FROM conf GROUP BY ALL""")
Q["f16_fix_plan"] = (
    lambda s, d: FX.plan(suggested(s, d)).withColumn("by_category", F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")),
    _SUG + "," + _CONF.replace("{src}", "sug2") + """, lv AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE fc >= 95) AS safe_fixes, count(*) FILTER (WHERE fc < 95 AND fc >= 30) AS need_confirmation, count(*) FILTER (WHERE fc < 30) AS manual_only FROM conf GROUP BY doc_id)
    SELECT lv.*, by_category, CAST(floor(safe_fixes * 0.5 + need_confirmation * 2 + manual_only * 5) AS INTEGER) AS seconds, CAST(floor((safe_fixes * 99 + need_confirmation * 80 + manual_only * 30) / total::DOUBLE) AS INTEGER) AS success_rate FROM lv
    JOIN (SELECT doc_id, string_agg(category || ':' || n, ',' ORDER BY category) AS by_category FROM (SELECT doc_id, category, count(*) AS n FROM conf GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""")
Q["f17_issue_plan"] = (
    lambda s, d: FX.issue_plan(issue_table(s, d)),
    iss() + f"""SELECT doc_id, count(*) AS actions, count(*) FILTER (WHERE autofix_allowed) AS safe_actions, 0 AS ai_actions, count(*) FILTER (WHERE NOT autofix_allowed) AS manual_actions,
    least(coalesce(sum({_GAIN}) FILTER (WHERE autofix_allowed), 0), 40) AS score_gain FROM iss GROUP BY doc_id""")
Q["f19_text_hash"] = (
    lambda s, d: documents(s, d).select("doc_id", F.sha2("text", 256).alias("text_hash")),
    "SELECT doc_id, sha256(text) AS text_hash FROM documents")
_LOC = _SUG + """, pos AS (SELECT s.*, d.text, d.n_lines, length(array_to_string(d.ls[1:s.line_start - 1], chr(10))) + CASE WHEN s.line_start > 1 THEN 1 ELSE 0 END AS a, d.ls[s.line_start] AS window_text FROM sug2 s JOIN docs d USING (doc_id)),
loc AS (SELECT *, CASE WHEN (length(window_text) - length(replace(window_text, original, ''))) / length(original) = 1 THEN a + strpos(window_text, original) - 1 WHEN (length(text) - length(replace(text, original, ''))) / length(original) = 0 THEN -1
  WHEN (length(text) - length(replace(text, original, ''))) / length(original) > 1 THEN -2 ELSE strpos(text, original) - 1 END AS start FROM pos)
"""
Q["f20_exact_location"] = (
    lambda s, d: FX.previews(drafts(s, d), suggested(s, d)).select("doc_id", "id", "start", "status"),
    _LOC + "SELECT doc_id, id, start, CASE WHEN start = -1 THEN 'stale' WHEN start = -2 THEN 'ambiguous' ELSE 'ok' END AS status FROM loc")
Q["f23_verify_f24_preview"] = (
    lambda s, d: FX.previews(drafts(s, d), suggested(s, d)).select("doc_id", "id", "before_hash", "after_hash", "needs_confirmation", "diff"),
    _LOC + "SELECT doc_id, id, CASE WHEN start < 0 THEN '' ELSE '-' || window_text || chr(10) || '+' || left(window_text, start - a) || suggested || substr(window_text, start - a + length(original) + 1) END AS diff, sha256(text) AS before_hash, CASE WHEN start >= 0 THEN sha256(left(text, start) || suggested || substr(text, start + length(original) + 1)) ELSE sha256(text) END AS after_hash, fix_type <> 'safe' OR confidence < 95 AS needs_confirmation FROM loc")
_BEST = _SUG + """, best AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM sug2
    QUALIFY row_number() OVER (PARTITION BY doc_id, line_start ORDER BY CASE fix_type WHEN 'safe' THEN 3 WHEN 'ai' THEN 1 ELSE 0 END DESC, confidence DESC, id) = 1)"""
# every suggestion is of one line, so those of one line overlap: the best of a line is applied, the others are blocked
Q["f21_f22_fixed_documents"] = (
    lambda s, d: FX.fixed_documents(drafts(s, d), suggested(s, d)).select("doc_id", F.sha2("fixed_text", 256).alias("digest"), F.size("applied").alias("applied"), F.size("blocked").alias("blocked")),
    _BEST + """
    SELECT l.doc_id, sha256(string_agg(CASE WHEN s.id IS NOT NULL THEN s.suggested || substr(l.line, length(s.original) + 1) ELSE l.line END, chr(10) ORDER BY l.line_no)) AS digest, count(s.id) AS applied, max(s.total) - count(s.id) AS blocked
    FROM lines l LEFT JOIN best s ON s.doc_id = l.doc_id AND s.line_start = l.line_no WHERE l.doc_id IN (SELECT doc_id FROM sug2) GROUP BY l.doc_id""")


def pairs(s, d):
    docs = drafts(s, d)
    return docs.select("doc_id", "text", FX.period_spacing(FX.hedging(F.col("text"))).alias("fixed_text"))


_PAIR = base() + f", pr AS (SELECT doc_id, text, replace(regexp_replace({chain('text', [(p if w else p + r'\s*', w or ' ') for p, w in X.HEDGING_FIXES])}, '\\.([A-Z])', '. \\1', 'g'), '.  ', '. ') AS fixed_text FROM docs)"
Q["f25_revert"] = (
    lambda s, d: FX.previews(drafts(s, d), suggested(s, d)).where("status = 'ok'").select("doc_id", "id", "before_hash", "reverted_hash"),
    _LOC + "SELECT doc_id, id, sha256(text) AS before_hash, sha256(text) AS reverted_hash FROM loc WHERE start >= 0")
Q["f26_line_diff"] = (lambda s, d: FX.diffs(pairs(s, d)), None)
Q["f26_word_diff"] = (lambda s, d: FX.diffs(pairs(s, d), "word").groupBy("doc_id", "kind").agg(F.count("*").alias("n")), None)
Q["f26_paragraph_diff"] = (lambda s, d: FX.diffs(pairs(s, d), "paragraph").groupBy("doc_id", "kind").agg(F.count("*").alias("n")), None)
Q["f26_diff_statistics"] = (
    lambda s, d: FX.diff_statistics(FX.diffs(pairs(s, d))).select("doc_id", (F.col("added") - F.col("removed")).alias("net_lines")),
    _PAIR + " SELECT doc_id, len(string_split(fixed_text, chr(10))) - len(string_split(text, chr(10))) AS net_lines FROM pr")
Q["f26_line_set_diff"] = (
    lambda s, d: FX.line_set_diff(pairs(s, d)),
    _PAIR + """ SELECT doc_id, line, sum(n) AS balance FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS n FROM pr UNION ALL SELECT doc_id, unnest(string_split(fixed_text, chr(10))), 1 FROM pr) GROUP BY doc_id, line HAVING sum(n) <> 0""")
Q["f27_unified_diff"] = (lambda s, d: FX.unified_diffs(pairs(s, d)), None)

# --- the store: sessions from orders, issues from line items ----------------------------------
SEV = ["high", "medium", "low"]
CATS = ["structure", "writing", "citation", "formatting", "logic", "compliance"]
STATUS = ["open", "resolved", "ignored"]
MESSAGES = ["Missing section", "Passive voice detected", "Heading level jumps", "No version number"]


def sessions(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_custkey") % 100).alias("user_id"),
        F.col("o_orderdate").alias("created_at"), F.concat(F.lit("file-"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("filename"),
        pick(PROFILE_CYCLE, key).alias("profile_id"), F.lower("o_orderstatus").alias("status"),
        (F.floor("o_totalprice") % 101).cast("int").alias("score"), F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("summary"))


def issues(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    part = F.col("l_partkey")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), part.cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").alias("session_id"), F.concat(F.lit("rule-"), (part % 5).cast("string")).alias("issue_id"),
        pick(CATS, F.col("l_suppkey")).alias("category"), F.concat(F.lit("rule."), (part % 40).cast("string")).alias("rule_id"), pick(SEV, part).alias("severity"),
        pick(MESSAGES, part + F.col("l_linenumber")).alias("message"), F.concat(F.lit("Fix item "), F.col("l_linenumber").cast("string")).alias("recommendation"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("evidence_excerpt"), F.col("l_linenumber").alias("evidence_line_start"),
        (F.col("l_linenumber") + 1).alias("evidence_line_end"), F.lit("document").alias("evidence_location"), F.col("l_quantity").cast("int").alias("confidence"),
        pick(STATUS, F.col("l_suppkey") + part).alias("status"), F.col("l_shipdate").alias("created_at"), (F.col("l_tax") > 0.04).alias("autofix_allowed"))


def stored_documents(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.lower("c_name").alias("original_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "text/html").otherwise("text/plain").alias("content_type"),
        F.timestamp_seconds(F.floor("c_acctbal").cast("bigint") + 1_700_000_000).alias("created_at"))


_STORE = f"""WITH ses AS (SELECT o_orderkey AS id, o_custkey AS document_id, o_custkey % 100 AS user_id, o_orderdate AS created_at, 'file-' || o_custkey || '.md' AS filename, {sql_pick(PROFILE_CYCLE, 'o_orderkey')} AS profile_id,
    lower(o_orderstatus) AS status, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, 'Priority ' || o_orderpriority AS summary FROM orders),
isu AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, l_orderkey AS session_id, 'rule-' || (l_partkey % 5) AS issue_id, {sql_pick(CATS, 'l_suppkey')} AS category, 'rule.' || (l_partkey % 40) AS rule_id, {sql_pick(SEV, 'l_partkey')} AS severity,
    {sql_pick(MESSAGES, 'l_partkey + l_linenumber')} AS message, 'Fix item ' || l_linenumber AS recommendation, 'Line ' || l_linenumber AS evidence_excerpt, l_linenumber AS evidence_line_start, l_linenumber + 1 AS evidence_line_end, 'document' AS evidence_location,
    CAST(l_quantity AS INTEGER) AS confidence, {sql_pick(STATUS, 'l_suppkey + l_partkey')} AS status, l_shipdate AS created_at, l_tax > 0.04 AS autofix_allowed FROM lineitem),
dcs AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS original_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'text/html' ELSE 'text/plain' END AS content_type,
    make_timestamp((CAST(floor(c_acctbal) AS BIGINT) + 1700000000) * 1000000) AS created_at FROM customer)
"""
_SO = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
Q["q01_list_sessions"] = (
    lambda s, d: S.list_sessions(sessions(s, d), search="urgent", score_min=20, score_max=90, profile_id="academic", limit=30, offset=5, total=True).select("id", "created_at", "filename", "score", "summary", "document_id", "total"),
    _STORE + "SELECT id, created_at, filename, score, summary, document_id, count(*) OVER () AS total FROM ses WHERE profile_id = 'academic' AND score BETWEEN 20 AND 90 AND (filename ILIKE '%urgent%' OR summary ILIKE '%urgent%') ORDER BY created_at DESC, id LIMIT 30 OFFSET 5")
Q["q01_sessions_matching"] = (
    lambda s, d: S.list_sessions(sessions(s, d), search="low", score_min=50, limit=None).select("id", "score"),
    _STORE + "SELECT id, score FROM ses WHERE score >= 50 AND (filename ILIKE '%low%' OR summary ILIKE '%low%')")
Q["q02_list_issues"] = (
    lambda s, d: S.list_issues(issues(s, d), 7, search="e", limit=None).select("id", "severity", "message", "status"),
    _STORE + "SELECT id, severity, message, status FROM isu WHERE session_id = 7 AND (message ILIKE '%e%' OR recommendation ILIKE '%e%')")
Q["q03_all_issues"] = (
    lambda s, d: S.list_all_issues(issues(s, d), sessions(s, d), search="passive", severity="high", limit=100, total=True).select("id", "session_filename", "profile_id", "total"),
    _STORE + f"SELECT i.id, s.filename AS session_filename, s.profile_id, count(*) OVER () AS total FROM isu i JOIN ses s ON s.id = i.session_id WHERE message ILIKE '%passive%' AND severity = 'high' ORDER BY {_SO}, i.created_at DESC, i.id LIMIT 100")
Q["q04_issue_evidence"] = (
    lambda s, d: S.issue_evidence(issues(s, d), sessions(s, d), issues(s, d).where("severity = 'high' AND confidence > 45").select("id")).select("id", "session_id", "evidence_excerpt", "evidence_line_start", "filename"),
    _STORE + "SELECT i.id, i.session_id, i.evidence_excerpt, i.evidence_line_start, s.filename FROM isu i JOIN ses s ON s.id = i.session_id WHERE i.id IN (SELECT id FROM isu WHERE severity = 'high' AND confidence > 45)")


def latest_sessions(s, d):
    """One session per document, so a history has one row per earlier occurrence and no pairs of sessions."""
    return sessions(s, d).groupBy("document_id").agg(F.max(F.struct("created_at", "id")).alias("b")).select(F.col("b.id").alias("session_id"))


Q["q05_issue_history"] = (
    lambda s, d: S.issue_history(issues(s, d), sessions(s, d), issues(s, d).join(latest_sessions(s, d), "session_id", "left_semi").select("session_id", "issue_id").distinct()).groupBy("asked_session", "issue_id").agg(
        F.count("*").alias("n"), F.max("session_created_at").alias("latest"), F.sum("session_score").alias("scores")),
    _STORE + """, ask AS (SELECT DISTINCT i.session_id, i.issue_id, s.document_id FROM isu i JOIN ses s ON s.id = i.session_id WHERE s.id IN (SELECT arg_max(id, (created_at, id)) FROM ses GROUP BY document_id))
    SELECT a.session_id AS asked_session, a.issue_id, count(*) AS n, max(s.created_at) AS latest, CAST(sum(s.score) AS BIGINT) AS scores FROM ask a JOIN ses s ON s.document_id = a.document_id AND s.id <> a.session_id JOIN isu i ON i.session_id = s.id AND i.issue_id = a.issue_id GROUP BY 1, 2""")
Q["q06_document_sessions"] = (
    lambda s, d: S.sessions_of_document(sessions(s, d), 42),
    _STORE + "SELECT id, created_at, profile_id, status, score, summary FROM ses WHERE document_id = 42")


def status_events(s, d):
    """Update events from the event log over the whole range of session ids: sessions, their categories, and every issue of some sessions."""
    e = s.read.parquet(f"{d}/events.parquet")
    top = s.read.parquet(f"{d}/orders.parquet").agg(F.max("o_orderkey").alias("top"))
    e = e.join(F.broadcast(top)).select(
        F.lit("session").alias("target"), F.pmod(F.col("event_id") * 7919, F.col("top") + 1).cast("string").alias("key"), "event_id",
        F.when(F.col("event_type").isin("click", "view"), pick(CATS, F.col("user_id"))).alias("category"), pick(STATUS, F.col("event_id") * 5 + F.col("user_id")).alias("status"), F.col("ts").alias("at"))
    one = e.where("event_id % 3 = 0").join(issues(s, d).select(F.col("session_id").cast("string").alias("key"), "id"), "key").select(
        F.lit("issue").alias("target"), F.col("id").alias("key"), "event_id", "category", "status", "at")
    return e.unionByName(one)


def logged_status(s, d):
    """The events come in four batches; the first two are compacted, one batch comes twice."""
    log = S.StatusLog(s, f"{shared_dir(s)}/status-{uuid.uuid4().hex}")
    events = status_events(s, d)
    for batch in (0, 1, 2, 3, 3):
        log.add(events.where(F.pmod("event_id", F.lit(4)) == batch), batch)
        if batch == 1:
            log.compact()
    return S.status_of(issues(s, d), log.state()).select("id", "status", "resolved_at")


_STATUS = _STORE + f""", ev AS (SELECT event_id, (event_id * 7919) % (1 + (SELECT max(o_orderkey) FROM orders)) AS k, CASE WHEN event_type IN ('click', 'view') THEN {sql_pick(CATS, 'user_id')} END AS category, {sql_pick(STATUS, 'event_id * 5 + user_id')} AS status, ts FROM events),
    m AS (SELECT k, category, max(ts) AS t, arg_max(status, (ts, status)) AS st, max(ts) FILTER (WHERE status IN ('resolved', 'ignored')) AS closed FROM ev GROUP BY k, category),
    o AS (SELECT i.id AS k, max(ts) AS t, arg_max(ev.status, (ts, ev.status)) AS st, max(ts) FILTER (WHERE ev.status IN ('resolved', 'ignored')) AS closed FROM ev JOIN isu i ON i.session_id = ev.k WHERE event_id % 3 = 0 GROUP BY i.id)
    SELECT i.id, CASE WHEN o.t = greatest(o.t, a.t, c.t) THEN o.st WHEN a.t = greatest(o.t, a.t, c.t) THEN a.st WHEN c.t IS NOT NULL THEN c.st ELSE i.status END AS status, greatest(o.closed, a.closed, c.closed) AS resolved_at
    FROM isu i LEFT JOIN (SELECT * FROM m WHERE category IS NULL) a ON a.k = i.session_id LEFT JOIN (SELECT * FROM m WHERE category IS NOT NULL) c ON c.k = i.session_id AND c.category = i.category LEFT JOIN o ON o.k = i.id"""
Q["q07_status_updates"] = (lambda s, d: S.current_status(issues(s, d), status_events(s, d)).select("id", "status", "resolved_at"), _STATUS)
Q["q07_status_log"] = (logged_status, _STATUS)
Q["q08_dashboard"] = (
    lambda s, d: S.dashboard(sessions(s, d), issues(s, d)),
    _STORE + """SELECT 'summary' AS section, 'total_reviews' AS key, count(*)::DOUBLE AS value FROM ses UNION ALL SELECT 'summary', 'average_score', round_even(avg(score), 0) FROM ses
    UNION ALL SELECT 'summary', 'total_issues', count(*) FROM isu UNION ALL SELECT 'summary', 'open_issues', count(*) FILTER (WHERE status = 'open') FROM isu UNION ALL SELECT 'summary', 'resolved_issues', count(*) FILTER (WHERE status = 'resolved') FROM isu
    UNION ALL SELECT 'by_severity', severity, count(*) FROM isu GROUP BY severity UNION ALL SELECT * FROM (SELECT 'category', category, count(*) AS c FROM isu GROUP BY category ORDER BY c DESC, category LIMIT 5)""")
Q["q08_recent_sessions"] = (
    lambda s, d: S.recent_sessions(sessions(s, d)), _STORE + "SELECT id, filename, profile_id, score, created_at FROM ses ORDER BY created_at DESC, id LIMIT 5")
Q["q09_category_shares"] = (
    lambda s, d: S.category_shares(issues(s, d)), _STORE + "SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM isu)::DOUBLE * 100, 1) AS percent FROM isu GROUP BY category")
Q["q09_score_trend"] = (
    lambda s, d: S.score_trend(sessions(s, d)), _STORE + "SELECT created_at, id, score FROM ses ORDER BY created_at DESC, id DESC LIMIT 10")


def run_pairs(s, d):
    """Every document's first and latest session."""
    return sessions(s, d).groupBy("document_id").agg(
        F.min(F.struct("created_at", "id")).alias("a"), F.max(F.struct("created_at", "id")).alias("b")).where("a.id <> b.id").select(
        F.col("document_id").alias("pair_id"), F.col("a.id").alias("first_session"), F.col("b.id").alias("second_session"))


Q["q10_compare_runs"] = (
    lambda s, d: S.compare_runs(issues(s, d), run_pairs(s, d), sessions(s, d)),
    _STORE + """, pr AS (SELECT document_id AS pair_id, arg_min(id, (created_at, id)) AS a, arg_max(id, (created_at, id)) AS b FROM ses GROUP BY document_id HAVING a <> b),
    pid AS (SELECT p.pair_id, i.issue_id, count(*) FILTER (WHERE i.session_id = p.a) AS n1, count(*) FILTER (WHERE i.session_id = p.b) AS n2,
      """ + ", ".join(f"count(*) FILTER (WHERE i.session_id = p.{x} AND severity = '{v}') AS {v}_{k}" for k, x in ((1, "a"), (2, "b")) for v in SEV) + """
      FROM pr p JOIN isu i ON i.session_id = p.a OR i.session_id = p.b GROUP BY 1, 2)
    SELECT pair_id, CAST(sum(n1) AS BIGINT) AS issues_1, CAST(sum(n2) AS BIGINT) AS issues_2, CAST(sum(n2) - sum(n1) AS BIGINT) AS issue_change, count(*) FILTER (WHERE n1 > 0 AND n2 = 0) AS improved, count(*) FILTER (WHERE n1 = 0 AND n2 > 0) AS new, count(*) FILTER (WHERE n1 > 0 AND n2 > 0) AS remaining,
    """ + ", ".join(f"CAST(sum({v}_2) - sum({v}_1) AS BIGINT) AS {v}_change" for v in SEV) + ", any_value(x.score) AS score_1, any_value(y.score) AS score_2, any_value(y.score - x.score) AS score_change FROM pid JOIN pr USING (pair_id) JOIN ses x ON x.id = pr.a JOIN ses y ON y.id = pr.b GROUP BY pair_id")
Q["q10_compared_ids"] = (
    lambda s, d: S.compared_ids(issues(s, d), run_pairs(s, d)),
    _STORE + """, pr AS (SELECT document_id AS pair_id, arg_min(id, (created_at, id)) AS a, arg_max(id, (created_at, id)) AS b FROM ses GROUP BY document_id HAVING a <> b),
    pid AS (SELECT p.pair_id, i.issue_id, bool_or(i.session_id = p.a) AS one, bool_or(i.session_id = p.b) AS two FROM pr p JOIN isu i ON i.session_id = p.a OR i.session_id = p.b GROUP BY 1, 2)
    SELECT pair_id, CASE WHEN NOT two THEN 'improved' WHEN NOT one THEN 'new' ELSE 'remaining' END AS kind, issue_id FROM pid""")
Q["q11_search"] = (
    lambda s, d: S.search(stored_documents(s, d), sessions(s, d), issues(s, d), "99", limit=None),
    _STORE + """SELECT 'document' AS kind, id, original_name AS label FROM dcs WHERE original_name ILIKE '%99%' UNION ALL SELECT 'session', CAST(id AS VARCHAR), filename FROM ses WHERE filename ILIKE '%99%' OR summary ILIKE '%99%'
    UNION ALL SELECT 'issue', id, message FROM isu WHERE message ILIKE '%99%' OR recommendation ILIKE '%99%'""")


def indexed_search(s, d, needle="riority 2"):
    index = S.SearchIndex(s, f"{shared_dir(s)}/search-{uuid.uuid4().hex}", parts=8)
    index.build(stored_documents(s, d), sessions(s, d), issues(s, d))
    return index.search(needle)


Q["q11_indexed_search"] = (
    indexed_search,
    _STORE + """SELECT 'document' AS kind, id, original_name AS label FROM dcs WHERE original_name ILIKE '%riority 2%' UNION ALL SELECT 'session', CAST(id AS VARCHAR), filename FROM ses WHERE filename ILIKE '%riority 2%' OR summary ILIKE '%riority 2%'
    UNION ALL SELECT 'issue', id, message FROM isu WHERE message ILIKE '%riority 2%' OR recommendation ILIKE '%riority 2%'""")
Q["q12_issue_stats"] = (
    lambda s, d: S.issue_stats(issues(s, d)),
    _STORE + f"""SELECT session_id, dimension, value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT session_id, 'severity' AS dimension, severity AS value, 1 AS n FROM isu UNION ALL SELECT session_id, 'category', category, 1 FROM isu UNION ALL SELECT session_id, 'status', status, 1 FROM isu
    UNION ALL SELECT session_id, t.a, t.b, 0 FROM (SELECT DISTINCT session_id FROM isu) CROSS JOIN (VALUES ('severity', 'high'), ('severity', 'medium'), ('severity', 'low'), ('status', 'open'), ('status', 'resolved'), ('status', 'ignored')) t(a, b)) GROUP BY ALL""")
_del = lambda s, d: sessions(s, d).where("score < 30").select(F.col("id").alias("session_id"))
Q["q13_cascade_delete"] = (
    lambda s, d: S.without_deleted(sessions(s, d), issues(s, d), _del(s, d))[1].select("id", "session_id"),
    _STORE + "SELECT id, session_id FROM isu WHERE session_id NOT IN (SELECT id FROM ses WHERE score < 30)")
Q["q14_timeline"] = (
    lambda s, d: S.timeline(sessions(s, d)),
    _STORE + """SELECT document_id, id, created_at, score, row_number() OVER w AS position, score - lag(score) OVER w AS score_change, CAST(epoch(created_at) - epoch(lag(created_at) OVER w) AS BIGINT) AS seconds_since FROM ses WINDOW w AS (PARTITION BY document_id ORDER BY created_at, id)""")
# --- fix history from line items -----------------------------------------------------------


def actions(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    part = F.col("l_partkey")
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("action_id"),
        F.col("l_orderkey").alias("session_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), (part % 3).cast("string")).alias("suggestion_id"),
        F.concat(F.lit("rule."), (part % 40).cast("string")).alias("rule_id"), F.when(F.col("l_returnflag") == "R", "revert").otherwise("apply").alias("action_type"),
        F.concat(F.lit("old "), part.cast("string")).alias("original_text"), F.concat(F.lit("new "), part.cast("string")).alias("patched_text"),
        (F.col("l_shipdate") + F.make_interval(secs=part)).alias("applied_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("reverted_at"),
        (F.col("l_linestatus") == "F").alias("finished"))


def finished(s, d):
    """Actions the log has closed; open ones are still being written."""
    return actions(s, d).where("finished")


_ACT = """WITH act AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS action_id, l_orderkey AS session_id, concat_ws('-', l_orderkey, l_partkey % 3) AS suggestion_id, 'rule.' || (l_partkey % 40) AS rule_id,
    CASE l_returnflag WHEN 'R' THEN 'revert' ELSE 'apply' END AS action_type, 'old ' || l_partkey AS original_text, 'new ' || l_partkey AS patched_text, l_shipdate + to_seconds(l_partkey) AS applied_at,
    CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 1 DAY END AS reverted_at, l_linestatus = 'F' AS finished FROM lineitem)
"""
Q["f28_change_summary"] = (
    lambda s, d: FX.change_summary(issues(s, d).where("status = 'resolved'")),
    _STORE + "SELECT dimension, value, count(*) AS n FROM (SELECT 'category' AS dimension, category AS value, status FROM isu UNION ALL SELECT 'rule', rule_id, status FROM isu UNION ALL SELECT 'severity', severity, status FROM isu) WHERE status = 'resolved' GROUP BY 1, 2")
Q["f29_cumulative_diff"] = (
    lambda s, d: FX.cumulative_diff(actions(s, d)),
    _ACT + """SELECT action_id, session_id, suggestion_id, rule_id, 'apply' AS action, original_text AS before, patched_text AS after, applied_at AS at_time FROM act WHERE action_type = 'apply'
    UNION ALL SELECT action_id, session_id, suggestion_id, rule_id, 'revert', patched_text, original_text, reverted_at FROM act WHERE reverted_at IS NOT NULL""")
Q["f29_cumulative_diff"] = (lambda s, d: FX.cumulative_diff(actions(s, d)).withColumnRenamed("at", "at_time"), Q["f29_cumulative_diff"][1])


def pending(s, d):
    return actions(s, d).groupBy("suggestion_id").agg(F.max("rule_id").alias("rule_id"), F.min("session_id").alias("session_id")).select(
        F.col("suggestion_id").alias("id"), "rule_id", F.when(F.col("session_id") % 2 == 0, "safe").otherwise("ai").alias("fix_type"), (F.lit(80) + F.col("session_id") % 20).cast("int").alias("confidence"))


_PEND = _ACT + """, pen AS (SELECT suggestion_id AS id, max(rule_id) AS rule_id, CASE WHEN min(session_id) % 2 = 0 THEN 'safe' ELSE 'ai' END AS fix_type, 80 + min(session_id) % 20 AS confidence FROM act GROUP BY suggestion_id),
lst AS (SELECT suggestion_id, arg_max(reverted_at IS NULL, applied_at) AS live FROM act GROUP BY suggestion_id)
"""
Q["f30_suggestion_status"] = (
    lambda s, d: FX.suggestion_status(pending(s, d), finished(s, d)).groupBy("applied").agg(F.count("*").alias("n")),
    _PEND + ", l3 AS (SELECT suggestion_id, arg_max(CASE WHEN reverted_at IS NULL THEN 1 ELSE 0 END, (applied_at, reverted_at)) AS live FROM act WHERE finished GROUP BY suggestion_id) SELECT coalesce(live, 0) = 1 AS applied, count(*) AS n FROM pen LEFT JOIN l3 ON l3.suggestion_id = pen.id GROUP BY 1")
Q["f31_one_click"] = (
    lambda s, d: FX.one_click(FX.suggestion_status(pending(s, d), finished(s, d))).select("id", "confidence"),
    _PEND + ", l3 AS (SELECT suggestion_id, arg_max(CASE WHEN reverted_at IS NULL THEN 1 ELSE 0 END, (applied_at, reverted_at)) AS live FROM act WHERE finished GROUP BY suggestion_id) SELECT id, confidence FROM pen LEFT JOIN l3 ON l3.suggestion_id = pen.id WHERE coalesce(live, 0) = 0 AND fix_type = 'safe' AND confidence >= 90")


def queries() -> dict:
    return {name: pair[0] for name, pair in Q.items() if pair[0]}


def oracles() -> dict[str, str]:
    return {name: pair[1] for name, pair in Q.items() if pair[1]}
