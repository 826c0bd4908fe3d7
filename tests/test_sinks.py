"""Idempotent sinks, user rules as table functions, and fixes applied through a piece table."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import fix as FX
from quillspark.operators.rules import tables
from quillspark.operators.rules.tables import TableRule, table_rule
from quillspark.session import shared_dir
from quillspark.sources import store as SS


def _read(spark, path):
    return sorted((r.run_id, r.batch, r.v) for r in spark.read.parquet(path).collect())


def test_a_repeated_batch_replaces_its_rows(spark):
    path = f"{shared_dir(spark)}/sink-{time.time_ns()}"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert SS.save_batch(rows(1, 2), path, "r1", "a") == 2
    SS.save_batch(rows(3), path, "r1", "b")
    SS.save_batch(rows(4), path, "r2", "a")
    before = _read(spark, path)
    SS.save_batch(rows(1, 2), path, "r1", "a")
    assert _read(spark, path) == before == [("r1", "a", 1), ("r1", "a", 2), ("r1", "b", 3), ("r2", "a", 4)]
    SS.save_batch(rows(9), path, "r1", "a")
    assert _read(spark, path) == [("r1", "a", 9), ("r1", "b", 3), ("r2", "a", 4)]
    assert SS.save_batch(rows(), path, "r1", "a") == 0
    assert _read(spark, path) == [("r1", "b", 3), ("r2", "a", 4)]
    with pytest.raises(ValueError):
        SS.save_batch(rows(1), path, "../r", "a")


@table_rule("test.repeated-line")
class RepeatedLines(TableRule):
    def __init__(self):
        self.seen = {}

    def line(self, number, text):
        if text in self.seen:
            yield {"issue_id": "again", "line_start": number, "line_end": self.seen[text]}
        self.seen.setdefault(text, number)

    def end(self):
        yield {"issue_id": "lines", "confidence": len(self.seen)}


def test_table_rules_keep_state_within_a_document(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "a"]), (2, ["b"]), (3, []), (4, None)], "doc_id long, lines array<string>")
    lateral = {(r.doc_id, r.issue_id, r.line_start, r.confidence) for r in tables.lateral_issues(docs, "test.repeated-line").collect()}
    assert lateral == {(1, "again", 3, None), (1, "again", 4, None), (1, "lines", None, 2), (2, "lines", None, 1), (3, "lines", None, 0), (4, "lines", None, 0)}
    lines = docs.select("doc_id", F.posexplode("lines").alias("p", "line")).withColumn("line_no", F.col("p") + 1).repartition(4, "line")
    table = {(r.doc_id, r.issue_id, r.line_start, r.confidence) for r in tables.issue_table(lines, "test.repeated-line").collect()}
    assert table == {x for x in lateral if x[0] < 3}


FIELDS = "doc_id long, id string, issue_id string, rule_id string, severity string, category string, original string, suggested string, line_start int, line_end int, confidence int, fix_type string"


def _fixed(spark, text, *fixes):
    rows = [(1, f"s{i}", "i", "r", "low", "writing", a, b, first, last, confidence, "safe") for i, (a, b, first, last, confidence) in enumerate(fixes)]
    return FX.fixed_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(rows, FIELDS)).first()


def test_fixes_of_several_lines_are_put_together_once(spark):
    text = "alpha beta\ngamma\ndelta é\n\nepsilon omega\nlast"
    done = _fixed(spark, text, ("beta\ngam", "B\nG", 1, 2, 90), ("é", "e\ne", 3, 3, 90), ("omega", "", 99, 99, 90), ("epsilon omega", "x", 5, 5, 90), ("last", "end", 6, 6, 90),
                  ("gone", "x", 4, 4, 90), ("a", "b", 98, 98, 90))
    assert done.fixed_text == "alpha B\nGma\ndelta e\ne\n\nx\nend"
    assert sorted(done.applied) == ["s0", "s1", "s3", "s4"] and done.blocked == []


def test_conflicts_go_to_the_surer_fix_of_their_cluster(spark):
    done = _fixed(spark, "a\nb\nc\nd", ("a\nb", "1", 1, 2, 50), ("b\nc", "2", 2, 3, 90), ("c\nd", "3", 3, 4, 60), ("a", "4", 1, 1, 40))
    assert done.fixed_text == "4\n2\nd" and sorted(done.applied) == ["s1", "s3"] and sorted(done.blocked) == ["s0", "s2"]


def test_an_untouched_text_and_previews(spark):
    assert _fixed(spark, "one\ntwo\n", ("zero", "x", 1, 1, 50)).fixed_text == "one\ntwo\n"
    fixes = spark.createDataFrame([(1, "s", "i", "r", "low", "writing", "two", "2\n3", 2, 2, 99, "safe")], FIELDS)
    p = FX.previews(spark.createDataFrame([(1, "one\ntwo x\nfour")], "doc_id long, text string"), fixes).first()
    assert p.status == "ok" and p.start == 4 and p.diff == "-two x\n+2\n+3 x" and p.reverted_hash == p.before_hash and not p.needs_confirmation


def test_twice_the_fixes_do_not_take_twice_the_time(spark):
    def seconds(n):
        text = "\n".join(f"line {i} of old{i}." for i in range(4000))
        rows = [(1, f"s{i}", "i", "r", "low", "writing", f"old{i}", f"new{i}", i + 1, i + 1, 90, "safe") for i in range(0, 4000, 4000 // n)]
        docs, fixes = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(rows, FIELDS)
        best = []
        for _ in range(2):
            started = time.perf_counter()
            done = FX.fixed_documents(docs, fixes).first()
            best.append(time.perf_counter() - started)
        assert len(done.applied) == n and done.fixed_text.count("new") == n
        return min(best)

    seconds(500)
    assert seconds(2000) < 2 * seconds(1000)


def test_exports_are_files_of_sessions(spark):
    sessions = spark.createDataFrame(
        [("session-1", "a<b>.md", "sop", 77, "He said, \"so\"\nand went", {"logic": 100, "writing": 7}), ("s2", None, None, None, None, None)],
        "id string, filename string, profile_id string, score int, summary string, category_scores map<string,int>").withColumn("created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    issue = ("i1", "session-1", "x", "writing", "writing.odd", "critical", "A, B & C", None, 'q "x"', "line 1", 50, "open")
    issues = spark.createDataFrame([issue], "id string, session_id string, issue_id string, category string, rule_id string, severity string, message string, recommendation string, "
                                            "evidence_excerpt string, evidence_location string, confidence int, status string").withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))
    at = F.lit("2024-05-01 10:30:00")
    text = SS.as_markdown(sessions, issues, exported_at=at)
    path = f"{shared_dir(spark)}/exports-{time.time_ns()}"
    for _ in range(2):
        SS.write_bodies(text, path, "md")
    SS.write_bodies(SS.as_csv(sessions, issues), path, "csv")
    files = {(r.format, r.session_id): r.value for r in spark.read.text(path, wholetext=True).collect()}
    want = {r.session_id: r.body for r in text.collect()}
    assert {k[1]: v for k, v in files.items() if k[0] == "md"} == {k: v + "\n" for k, v in want.items()}
    assert "**Session:** session-\n" in want["session-1"] and all(line in want["session-1"] for line in ("- **logic:** 100/100  `██████████`\n", "- **writing:** 7/100  `░░░░░░░░░░`\n"))
    assert "### 1. critical — A, B & C\n" in want["session-1"] and want["session-1"].endswith("---\n*Generated by Review Report on 2024-05-01 10:30 UTC*")
    assert "## Issues\nNo issues found.\n---" in want["s2"]
    body = SS.as_csv(sessions, issues).where("session_id = 'session-1'").first().body.split("\r\n")
    assert body[0].startswith("Session ID,") and '77,"He said, ""so""\nand went"' in body[1] and body[2] == "" and 'critical,writing,writing.odd,"A, B & C",50,open,line 1,,"q ""x"""' in body[4]
    page = SS.as_html(sessions, issues, exported_at=at).where("session_id = 'session-1'").first().body
    assert "a&lt;b&gt;.md" in page and "A, B &amp; C" in page and "<h2>Issues (1)</h2>" in page and 'style="width:7%"' in page
