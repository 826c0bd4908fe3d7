"""The manuscript corpus the rule queries run on.

The `documents` table is plain prose without headings, references or captions, so most
rules would have nothing to find. ``drafts`` derives a manuscript from every document, line
by line: a title, section headings, citations, figure captions, typical slips and a reference
list, chosen by document id and line number. The same expression exists for DuckDB, so both
sides read the whole table and the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.session import read_table

PROFILE_CYCLE = ["general", "academic", "business", "legal", "research", "sop", "technical_design"]
FILENAMES = [
    "field-notes.md", "thesis transit.md", "pump sop v2.md", "payments api spec.md", "market proposal.md",
    "release-notes.md", "iso policy.md", "lab report 7.md", "user guide.md", "design minutes.md", "memo.md",
]
TITLES = [
    "Quarterly Field Notes", "Thesis on Transit Demand", "Standard Operating Procedure for Pumps",
    "Payment API Reference", "Market Entry Proposal", "System Design of the Relay", "Plain Memo",
]
OPENINGS = ["# ", "# ", "## ", "# ", "### "]
HEADINGS = [
    "Abstract", "Introduction", "Methodology", "Results", "Discussion", "Conclusion", "References", "Keywords",
    "Related Work", "Literature Review", "Purpose", "Scope", "Procedure", "Responsibility", "Revision History",
    "Approval", "Safety", "Overview", "Architecture", "Components", "Deployment", "Executive Summary", "Background",
    "Objectives", "Budget", "Agenda", "Attendees", "Action Items", "1 Setup", "2.1 Detailed Setup", "IV. Annex",
    "Appendix", "Parties", "Terms", "Definitions", "Policy", "Compliance", "Survey", "Endpoints", "Timeline",
    "Results", "Introduction", "Conclusion", "References", "Methodology",
]
LEVELS = ["## ", "## ", "### ", "## ", "##### ", "# "]
TAILS = [
    " The pump was opened by the crew.", " See [1] and [2].", " It is shown (Smith, 2020).", " Jones (2019) agrees.",
    " See Figure 2 for details.", " Compare Table 3 here.", " However, we may recieve it later.",
    " The NLP team uses AI tools.", " Signed on 12/03/2024.", " Version 0.9 applies.", " Warning: hot surface.",
    " Visit http://localhost/page or //mirror/page now.", " Look at https://doi.org/10.1000/xyz1 for more.",
    " in order to win, perhaps.", " This clearly proves that our results hold.", " All of it, but some say no.",
    " You must comply with every requirement.", " It's very good, really important and just big.",
    " An e-mail or email is fine.", " The database and data-base differ.", " Due on 2024-05-01, ten of 12 units.",
    " Their effect is seperate , definately.", " [4] (Lee, 2026) and (Kim et al., 1850).", " x^{2,3} and y^{4}.",
    " Thus, therefore, thus, thus and thus.", " audit trail and access control apply", " data integrity matters (WHO).",
    " Meeting with attendees on action items.", " In recent years a lot of work was done.",
    " Fig. 1 and Table 1 are fine..", " Mail ann.lee@example.com or call 555-123-4567.",
    " In contrast to that, similarly to this.", " Nothing is due to the fact that it rains.",
    " step 1 of the procedure; the API is REST.", " (See the note (below).", ' He said "yes" and "no" twice.',
    " It could of been worse than the last.", " Contact 10.0.0.1 or 123-45-6789 today.",
    " (Smith and Lee 2018) wrote it.Then they left , slowly.", " Between 3 May 2021 and June 5, 2022.",
    " Similarly, in contrast to the DNA data, GPU use rose.",
]
CAPTIONS = [
    "Figure 1: Flow of the process.", "Figure 3: Pump layout", "Fig. 2: Control loop.", "Table 1: Measured values",
    "Table 3. Rates by year.", "![chart](chart.png) insert figure here", "Figure 4: ", "Table 2: A figure of merit",
    "Equation 1: a = b", "| name | value |", "1. Open the valve.", "Summary of Findings", "Conclusion",
    "Glacier Harbor Lantern results differ.", "Introduction to the rest",
]
REFERENCES = [
    "J. K. Rowan, 'On pumps,' Press, 2019.", "Smith, A. (2020). Transit demand. doi: 10.1000/182",
    "[1] K. Lee, Relay design, 2018.", "2 Unnumbered entry without initials", "Smith, A. (2020). Transit demand. doi: 10.1000/182",
    "DOI: 10.5555/abc", "Kim and Park 2017",
]


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[CAST(({index}) % {len(values)} + 1 AS INTEGER)]"


def draft_text(doc_id: Column, text: Column) -> Column:
    title = F.concat(pick(OPENINGS, doc_id), pick(TITLES, doc_id))

    def around(line: Column, i: Column) -> Column:
        n = i + 1
        key = doc_id * 7 + n * 3
        heading = F.when((doc_id + n * 2) % 3 == 0, F.concat(pick(LEVELS, doc_id + n), pick(HEADINGS, doc_id * 5 + n * 11)))
        body = F.concat(line, F.when(key % 2 == 0, pick(TAILS, doc_id * 3 + n * 7)).otherwise(F.lit("")))
        caption = F.when((doc_id + n) % 4 == 1, pick(CAPTIONS, doc_id * 2 + n * 5))
        gap = F.when((doc_id + n) % 5 == 2, F.lit(""))
        return F.array(heading, body, caption, gap)

    body = F.array_compact(F.flatten(F.transform(F.split(text, "\n", -1), around)))
    tail = F.when(
        doc_id % 3 > 0,
        F.array(F.when(doc_id % 13 == 5, F.lit("## Tài liệu tham khảo")).otherwise(F.lit("## References")), pick(REFERENCES, doc_id), pick(REFERENCES, doc_id * 2 + 1), F.lit(""),
                pick(REFERENCES, doc_id * 3 + 4)),
    ).otherwise(F.array().cast("array<string>"))
    head = F.when(doc_id % 11 == 3, F.array().cast("array<string>")).otherwise(F.array(title, F.lit("")))
    return F.array_join(F.concat(head, body, tail), "\n")


def profile_of(source: Column) -> Column:
    return pick(PROFILE_CYCLE, F.regexp_extract(source, r"(\d+)$", 1).cast("int"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "source", "text")
    return docs.select(
        "doc_id", profile_of(F.col("source")).alias("profile_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), pick(FILENAMES, F.col("doc_id"))).alias("filename"),
        F.lower(pick(TITLES, F.col("doc_id"))).alias("meta_title"),
        draft_text(F.col("doc_id"), F.col("text")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw documents with the profile their source is routed to."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "source", "text")
    return docs.select("doc_id", profile_of(F.col("source")).alias("profile_id"), "text")


# --- the same corpus for the oracle ----------------------------------------------------
_AROUND = f"""list_transform(string_split(text, chr(10)), lambda line, n: [
    CASE WHEN (doc_id + n * 2) % 3 = 0 THEN {sql_pick(LEVELS, 'doc_id + n')} || {sql_pick(HEADINGS, 'doc_id * 5 + n * 11')} END,
    line || CASE WHEN (doc_id * 7 + n * 3) % 2 = 0 THEN {sql_pick(TAILS, 'doc_id * 3 + n * 7')} ELSE '' END,
    CASE WHEN (doc_id + n) % 4 = 1 THEN {sql_pick(CAPTIONS, 'doc_id * 2 + n * 5')} END,
    CASE WHEN (doc_id + n) % 5 = 2 THEN '' END])"""
SQL_PROFILE = sql_pick(PROFILE_CYCLE, "CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER)")
DRAFTS_SQL = f"""drafts AS (
  SELECT doc_id, {SQL_PROFILE} AS profile_id,
    CAST(doc_id AS VARCHAR) || '-' || {sql_pick(FILENAMES, 'doc_id')} AS filename,
    lower({sql_pick(TITLES, 'doc_id')}) AS meta_title,
    array_to_string(list_concat(
      CASE WHEN doc_id % 11 = 3 THEN [] ELSE [{sql_pick(OPENINGS, 'doc_id')} || {sql_pick(TITLES, 'doc_id')}, ''] END,
      list_filter(flatten({_AROUND}), lambda x: x IS NOT NULL),
      CASE WHEN doc_id % 3 > 0 THEN [CASE WHEN doc_id % 13 = 5 THEN '## Tài liệu tham khảo' ELSE '## References' END, {sql_pick(REFERENCES, 'doc_id')},
        {sql_pick(REFERENCES, 'doc_id * 2 + 1')}, '', {sql_pick(REFERENCES, 'doc_id * 3 + 4')}] ELSE [] END
    ), chr(10)) AS text
  FROM documents)"""
RAW_SQL = f"raw_docs AS (SELECT doc_id, {SQL_PROFILE} AS profile_id, text FROM documents)"
