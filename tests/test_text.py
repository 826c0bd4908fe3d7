"""Parsing, chunks, HTML, sentences, fixes, safety on small inputs."""

from pyspark.sql import functions as F

from quillspark.operators import document as DOC, fix as FX, safety as L
from quillspark.operators.parse import parse
from quillspark.sources import html


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")


def test_chunks_cover_the_text_and_move_forward(spark):
    text = ("# Head\n" + "Some words here. More words follow!\n\n" * 40) * 3
    for size, overlap in ((200, 20), (1000, 100), (50, 49)):
        spans = [(r.start_char, r.end_char) for r in DOC.boundary_chunks(texts(spark, text), size, overlap).orderBy("chunk").collect()]
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b and b - a <= size


def test_sections_partition_the_text(spark):
    text = "intro\n# A\nbody\n#### not a section\n## B\nend"
    rows = DOC.section_chunks(texts(spark, text, "# A\nx")).orderBy("doc_id", "chunk").collect()
    first = [r for r in rows if r.doc_id == 0]
    assert "".join(text[r.start_char:r.end_char] for r in first) == text
    assert [r.section for r in first] == ["document-start", "A", "B"]
    assert [(r.start_char, r.end_char, r.section) for r in rows if r.doc_id == 1] == [(0, 5, "A")]


def test_sentences_keep_abbreviations(spark):
    rows = DOC.sentence_rows(texts(spark, "Dr. Smith left. He ran! Then (maybe) e.g. Paris.")).orderBy("sentence").collect()
    assert [r.text for r in rows] == ["Dr. Smith left.", "He ran!", "Then (maybe) e.g. Paris."]
    assert [r.start_char for r in rows] == [0, 16, 24]


def test_html_blocks():
    page = html.read_page(
        "<html><head><title>A &amp; B</title><meta name='author' content='Me'></head><body><nav>x</nav><h2>Top</h2>"
        "<p>One <b>two</b></p><ul><li>item</ul><form><input><p>gone</p></form><table><tr><td>a</td><td>b</td></tr></table>tail")
    assert page.title == "A & B" and page.meta["author"] == "Me"
    assert page.blocks == [("heading", "Top", 2), ("paragraph", "One two", 0), ("list_item", "item", 0), ("table", "a | b", 0), ("paragraph", "tail", 0)]


def test_headings_and_references(spark):
    row = parse(texts(spark, "# T \r\n## References\n[1] A\n\n B \n# End\nx")).first()
    assert [(h.level, h.title, h.line_no) for h in row.headings] == [(1, "T", 1), (2, "References", 2), (1, "End", 6)]
    assert row.refs == ["[1] A", "B"]


def suggestion(**over):
    base = dict(doc_id=0, id="fix-1", issue_id="i", rule_id="period-spacing", severity="low", category="format", original="Wrong.Text",
                suggested="Wrong. Text", line_start=2, line_end=2, confidence=99, fix_type="safe")
    return {**base, **over}


def apply(spark, text, *rows):
    return FX.fixed_documents(texts(spark, text), spark.createDataFrame([suggestion(**r) for r in rows])).first()


def test_apply_changes_only_the_excerpt(spark):
    assert apply(spark, "Title\nPrefix Wrong.Text suffix\nEnd", {}).fixed_text == "Title\nPrefix Wrong. Text suffix\nEnd"


def test_stale_and_ambiguous_sources_are_left_alone(spark):
    stale = FX.previews(texts(spark, "Title\nAlready fixed.\n"), spark.createDataFrame([suggestion()])).first()
    twice = FX.previews(texts(spark, "Wrong.Text\nWrong.Text"), spark.createDataFrame([suggestion(line_start=3, line_end=3)])).first()
    assert (stale.status, twice.status) == ("stale", "ambiguous")
    assert stale.before_hash == stale.after_hash


def test_revert_restores_the_text(spark):
    fixed = apply(spark, "A\nWrong.Text\nB", {}).fixed_text
    row = spark.createDataFrame([(fixed,)], "text string").select(FX.reverted(F.col("text"), F.struct(
        F.lit("Wrong.Text").alias("original"), F.lit("Wrong. Text").alias("suggested"), F.lit(2).alias("line_start"),
        F.lit(2).alias("line_end"))).alias("t")).first()
    assert row.t == "A\nWrong.Text\nB"


def test_the_safe_and_surer_fix_wins(spark):
    row = apply(spark, "A\nWrong.Text\nB", dict(id="blocked", suggested="Different text", confidence=70, fix_type="ai"), dict(id="winner"))
    assert row.fixed_text == "A\nWrong. Text\nB" and row.applied == ["winner"] and row.blocked == ["blocked"]


def test_spelling_suggestion(spark):
    issues = spark.createDataFrame(
        [(0, "i", "writing.spelling", "low", "writing", "We recieve the result.", 1, 1, 95, True)],
        "doc_id bigint, issue_id string, rule_id string, severity string, category string, excerpt string, line_start int, line_end int, confidence int, autofix_allowed boolean")
    row = FX.suggestions(issues).first()
    assert row.suggested == "We receive the result." and row.fix_type == "ai"
    assert row.id == FX.suggestions(issues).first().id


def test_redaction_leaves_nothing_to_find(spark):
    text = "Mail a.b@c.org, call +1 555-123-4567, 123-45-6789, 1234-5678-1234-5678, 10.0.0.1, sk-abcdefghijklmnopqrstuv " + "a.b@c.org " * 9
    clean = texts(spark, text).select("doc_id", L.redacted(F.col("text")).alias("text"))
    assert L.pii_rows(clean, limit=None).count() == 0
    assert clean.first().text.startswith("Mail [REDACTED_EMAIL], call")


def test_reply_shapes(spark):
    good = '{"category": "a", "rule_id": "b", "severity": "high", "message": "c", "recommendation": "d"}'
    replies = spark.createDataFrame(
        [(1, f"```json\n[{good}]\n```"), (2, f"see [{good}, {good}]"), (3, '{"issues": [%s]}' % good), (4, f"```\n[{good},]\n```"), (5, "none")],
        "doc_id bigint, reply string")
    counts = {r.doc_id: r["count"] for r in L.reply_items(replies).groupBy("doc_id").count().collect()}
    assert counts == {1: 1, 2: 2, 3: 1, 4: 1}


def test_diff_statistics(spark):
    pair = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd")], "doc_id bigint, text string, fixed_text string")
    row = FX.diff_statistics(FX.diffs(pair)).first()
    assert (row.added, row.removed, row.same) == (2, 1, 2)
