"""Session, issue, document and template tables, and the exports of a session."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..operators.fix import stable_id


def session_rows(scored: DataFrame, run_id: str, created_at: Column) -> DataFrame:
    """One session row per reviewed document."""
    return scored.select(
        stable_id(F.lit(run_id), F.col("doc_id")).alias("id"), F.lit(run_id).alias("run_id"),
        F.col("doc_id").alias("document_id"), created_at.alias("created_at"), "profile_id", "categories",
        F.lit("completed").alias("status"), "score", "category_scores", "summary")


def stored_issues(issues: DataFrame, run_id: str) -> DataFrame:
    """Issue rows of a run, all open."""
    session = stable_id(F.lit(run_id), F.col("doc_id"))
    return issues.select(
        stable_id(session, F.col("seq")).alias("id"), session.alias("session_id"), F.lit(run_id).alias("run_id"),
        "issue_id", "category", "rule_id", "severity", "message", "recommendation",
        F.col("excerpt").alias("evidence_excerpt"), F.col("line_start").alias("evidence_line_start"),
        F.col("line_end").alias("evidence_line_end"), F.col("location").alias("evidence_location"), "confidence",
        "source", "autofix_allowed", F.lit("open").alias("status"))


_NAME = re.compile(r"[A-Za-z0-9._-]+")


def replace(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes every partition that the rows fall in anew and leaves the others alone: a repeated write changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def save_batch(rows: DataFrame, path: str, run_id: str, batch: str) -> int:
    """The rows as the whole content of partition (run_id, batch) of a table; gives their number.

    A repeated batch replaces its rows, also by none: dynamic overwrite leaves a partition without new rows as it was,
    so that one is removed. Other batches and runs are not touched.
    """
    for value in (run_id, batch):
        if not _NAME.fullmatch(value):
            raise ValueError(f"not a name for a partition: {value!r}")
    seen = Observation()
    rows = rows.withColumns({"run_id": F.lit(run_id), "batch": F.lit(batch)})
    replace(rows.observe(seen, F.count(F.lit(1)).alias("n")), path, "run_id", "batch")
    if not seen.get["n"]:
        spark = rows.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}/batch={batch}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return seen.get["n"]


def save_run(scored: DataFrame, issues: DataFrame, folder: str, run_id: str, created_at: Column, batch: str = "all") -> None:
    """Sessions and issues of a batch of a run; a repeated call replaces them."""
    save_batch(session_rows(scored, run_id, created_at), f"{folder}/sessions", run_id, batch)
    save_batch(stored_issues(issues, run_id), f"{folder}/issues", run_id, batch)


def action_rows(fixed: DataFrame, run_id: str, applied_at: Column) -> DataFrame:
    """One row for each fix that was applied to a document. ``fixed`` comes from ``fix.fixed_documents``.

    The patched text itself is stored once, with the document; an action names it by its hash.
    """
    session = stable_id(F.lit(run_id), F.col("doc_id"))
    rows = fixed.select("doc_id", F.sha2("fixed_text", 256).alias("patched_hash"), F.inline("actions"))
    return rows.select(
        stable_id(session, F.col("id"), F.lit("apply")).alias("id"), session.alias("session_id"), F.lit(run_id).alias("run_id"),
        F.col("id").alias("suggestion_id"), "issue_id", "rule_id", F.lit("apply").alias("action_type"), F.col("original").alias("original_text"),
        F.col("suggested").alias("patched_text"), "line_start", "line_end", "patched_hash", applied_at.cast("timestamp").alias("applied_at"),
        F.lit(None).cast("timestamp").alias("reverted_at"))


def save_actions(fixed: DataFrame, folder: str, run_id: str, applied_at: Column, batch: str = "all") -> int:
    """The applied fixes of a batch of a run as a table; a repeated call replaces them."""
    return save_batch(action_rows(fixed, run_id, applied_at), f"{folder}/fix_actions", run_id, batch)


def list_documents(documents: DataFrame, search: str | None = None, content_type: str | None = None,
                   limit: int | None = None, offset: int = 0, total: bool = False) -> DataFrame:
    """S09; with ``total``, the number of documents that match beside each row."""
    from ..plans.store import _equal, _ilike, page

    keep = _equal(content_type=content_type) & _ilike(search, "original_name", "id")
    return page(documents.where(keep), [F.desc("created_at"), "id"], limit, offset, total)


def template_rows(learned: DataFrame, names: DataFrame) -> DataFrame:
    """Each learned template with its source file as one JSON value, keyed by what it says, so that a template learned again is the same row.

    ``learned`` comes from ``template.learn``, ``names(doc_id, source_filename)`` tells the files.
    """
    rows = learned.join(names.select("doc_id", "source_filename"), "doc_id")
    analysis = F.to_json(F.struct("source_filename", F.lit(1).alias("version"), *[c for c in learned.columns if c != "doc_id"]))
    return rows.select(stable_id(F.col("doc_id"), analysis).alias("id"), "doc_id", "source_filename", analysis.alias("analysis"))


# --- exports: a session's issues fold into one ordered array (bounded by its document) ------


def session_documents(sessions: DataFrame, issues: DataFrame) -> DataFrame:
    """Sessions with their issues: by severity, the newest first, then by id."""
    from ..plans.store import severity_order

    fields = ["id", "issue_id", "category", "rule_id", "severity", "message", "recommendation", "evidence_excerpt",
              "evidence_location", "confidence", "status"]
    keyed = F.struct(severity_order().alias("rank"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "id", F.struct(*fields).alias("x"))
    folded = issues.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda k: k["x"]).alias("issues"))
    empty = F.array().cast(folded.schema["issues"].dataType)
    return sessions.withColumnRenamed("id", "session_id").join(folded, "session_id", "left").withColumn("issues", F.coalesce("issues", empty))


def when(at: Column | None) -> Column:
    """The time of an export as text, to the minute."""
    return F.date_format(F.current_timestamp() if at is None else at.cast("timestamp"), "yyyy-MM-dd HH:mm 'UTC'")


def dated(column: str) -> Column:
    return F.coalesce(F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))


def short_id() -> Column:
    return F.left(F.col("session_id").cast("string"), F.lit(8))


def shown(value: Column, missing: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def scores_of(whole: DataFrame, each) -> Column:
    """``each(category, score)`` for the entries of the session's category scores, in their order."""
    if "category_scores" not in whole.columns:
        return F.array().cast("array<string>")
    return F.coalesce(F.transform(F.map_entries("category_scores"), lambda e: each(e["key"], e["value"])), F.array().cast("array<string>"))


def as_json(sessions: DataFrame, issues: DataFrame, exported_at: Column | None = None) -> DataFrame:
    """The session, its issues in export order, and the time of the export."""
    whole = session_documents(sessions, issues).withColumn("created_at", dated("created_at"))
    plain = [c for c in whole.columns if c not in ("issues", "session_id")]
    session = F.struct(F.col("session_id").alias("id"), *plain)
    return whole.select("session_id", F.to_json(F.struct(session.alias("session"), "issues", when(exported_at).alias("exported_at"))).alias("body"))


CSV_HEADER = ["Session ID", "Profile", "Document", "Date", "Score", "Summary"]
CSV_TITLES = ["Issue ID", "Severity", "Category", "Rule", "Message", "Confidence", "Status", "Location", "Recommendation", "Evidence"]
CSV_COLUMNS = ["issue_id", "severity", "category", "rule_id", "message", "confidence", "status", "evidence_location",
               "recommendation", "evidence_excerpt"]


def csv_line(values: list[Column]) -> Column:
    """One line of comma-separated fields; those with commas, quotes or line breaks are quoted. Without its line end."""
    def field(value: Column) -> Column:
        text = shown(value)
        return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[field(v) for v in values])


def as_csv(sessions: DataFrame, issues: DataFrame) -> DataFrame:
    """The session's row under its header, an empty line, and the issues under theirs; lines end in CR LF."""
    whole = session_documents(sessions, issues)
    head = [F.lit(",".join(CSV_HEADER)), csv_line([short_id(), F.col("profile_id"), F.col("filename"), dated("created_at"), F.col("score"), F.col("summary")]),
            F.lit(""), F.lit(",".join(CSV_TITLES))]
    rows = F.transform("issues", lambda i: csv_line([i[c] for c in CSV_COLUMNS]))
    return whole.select("session_id", F.concat(F.array_join(F.concat(F.array(*head), rows), "\r\n"), F.lit("\r\n")).alias("body"))


def write_bodies(bodies: DataFrame, path: str, extension: str) -> None:
    """One file for each session, in a folder of its own, through Spark's partitioned text writer."""
    bodies.select("session_id", F.lit(extension).alias("format"), "body").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "lineSep", "\n").partitionBy("format", "session_id").text(path)


def as_markdown(sessions: DataFrame, issues: DataFrame, title: str = "Review Report", exported_at: Column | None = None) -> DataFrame:
    """S14."""
    badge = lambda s: F.when(s == "high", "🔴 HIGH").when(s == "medium", "🟡 MEDIUM").when(s == "low", "🟢 LOW").otherwise(s)

    def section(i: Column, n: Column) -> Column:
        return F.concat(
            F.lit("### "), (n + 1).cast("string"), F.lit(". "), shown(badge(i["severity"])), F.lit(" — "), shown(i["message"]),
            F.lit("\n- **Category:** "), shown(i["category"], "N/A"), F.lit("\n- **Rule:** `"), shown(i["rule_id"], "N/A"),
            F.lit("`\n- **Confidence:** "), shown(i["confidence"], "0"), F.lit("%\n- **Status:** "), shown(i["status"], "open"),
            F.lit('\n- **Evidence:** "'), shown(i["evidence_excerpt"]), F.lit('"\n- **Location:** '), shown(i["evidence_location"], "N/A"),
            F.lit("\n- **Recommendation:** "), shown(i["recommendation"], "N/A"), F.lit("\n"))

    def bar(category: Column, score: Column) -> Column:
        full = F.floor(score / 10).cast("int")
        return F.concat(F.lit("- **"), category, F.lit(":** "), score.cast("string"), F.lit("/100  `"), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 10 - full), F.lit("`"))

    whole = session_documents(sessions, issues)
    head = [F.lit(f"# {title}"), F.lit(""), F.concat(F.lit("**Session:** "), short_id()), F.concat(F.lit("**Profile:** "), shown(F.col("profile_id"))),
            F.concat(F.lit("**Document:** "), shown(F.col("filename"))), F.concat(F.lit("**Date:** "), dated("created_at")),
            F.concat(F.lit("**Overall Score:** "), shown(F.col("score")), F.lit("/100")), F.lit(""), F.lit("## Category Scores")]
    middle = [F.lit(""), F.lit("## Summary"), F.lit(""), shown(F.col("summary")), F.lit(""), F.lit("## Issues")]
    listed = F.when(F.size("issues") == 0, F.array(F.lit("No issues found."))).otherwise(F.transform("issues", section))
    end = [F.lit("---"), F.concat(F.lit(f"*Generated by {title} on "), when(exported_at), F.lit("*"))]
    return whole.select("session_id", F.array_join(F.concat(F.array(*head), scores_of(whole, bar), F.array(*middle), listed, F.array(*end)), "\n").alias("body"))


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


STYLE = ("body{font-family:sans-serif;margin:2em auto;max-width:56em}.bar{background:#ddd}.fill{background:#176;height:.7em}"
         ".issue{border-left:4px solid #39f;padding:.5em 1em}.high{border-color:#d22}.medium{border-color:#da0}")


def as_html(sessions: DataFrame, issues: DataFrame, title: str = "Review Report", exported_at: Column | None = None) -> DataFrame:
    """A page with the score, the category bars, the summary and every issue; all texts are escaped."""
    text = lambda c, missing="": escaped(shown(c, missing))
    icon = lambda s: F.when(s == "high", "🔴 ").when(s == "medium", "🟡 ").when(s == "low", "🟢 ").otherwise("")

    def block(i: Column) -> Column:
        return F.concat(
            F.lit('<div class="issue '), text(i["severity"]), F.lit('"><p><b>'), icon(i["severity"]), F.upper(text(i["severity"])), F.lit("</b> <span>"), text(i["category"]),
            F.lit("</span> <span>"), text(i["confidence"], "0"), F.lit("% confidence</span> <span>"), text(i["status"], "open"), F.lit("</span></p><h4>"), text(i["message"]),
            F.lit("</h4><blockquote>&quot;"), text(i["evidence_excerpt"]), F.lit("&quot;</blockquote><p><b>Recommendation:</b> "), text(i["recommendation"]),
            F.lit("</p><p>Rule: <code>"), text(i["rule_id"]), F.lit("</code> &middot; Location: "), text(i["evidence_location"]), F.lit("</p></div>"))

    def bar(category: Column, score: Column) -> Column:
        return F.concat(F.lit("<div><span>"), text(category), F.lit('</span><div class="bar"><div class="fill" style="width:'), F.least(score, F.lit(100)).cast("string"),
                        F.lit('%"></div></div><b>'), score.cast("string"), F.lit("</b></div>"))

    whole = session_documents(sessions, issues)
    color = F.when(F.col("score") >= 80, "#22c55e").when(F.col("score") >= 50, "#eab308").otherwise("#ef4444")
    listed = F.when(F.size("issues") == 0, "<p>No issues found.</p>").otherwise(F.array_join(F.transform("issues", block), ""))
    return whole.select("session_id", F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>' + title + " — "), escaped(short_id()), F.lit(f"</title><style>{STYLE}</style></head><body><h1>{title}</h1><p>"),
        text(F.col("filename"), "N/A"), F.lit(" &middot; "), text(F.col("profile_id"), "N/A"), F.lit(' profile</p><p><b style="color:'), color, F.lit('">'), shown(F.col("score")),
        F.lit("</b></p><p>"), text(F.col("summary")), F.lit("</p><h2>Category Scores</h2>"), F.array_join(scores_of(whole, bar), ""), F.lit("<h2>Issues ("), F.size("issues").cast("string"),
        F.lit(")</h2>"), listed, F.lit("<hr><p>Generated by " + title + " on "), when(exported_at), F.lit("</p></body></html>")).alias("body"))
