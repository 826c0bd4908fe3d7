"""As-of lookups, validation sweeps and JVM-side chunks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import document as DOC
from quillspark.operators.parse import parse


def _spans(seed, n, disjoint):
    rnd, rows, at = random.Random(seed), [], 0
    for i in range(n):
        a = at + rnd.randint(1, 4) if disjoint else rnd.randint(0, 60)
        b = a + rnd.choice([0, 0, 1, 3, 20])
        at = b
        rows.append((1, i, i % 3, a, b))
    return rows


@pytest.mark.parametrize("disjoint", [True, False])
def test_offsets_meet_their_first_block(spark, disjoint):
    rows = _spans(1, 30, disjoint)
    mapped = spark.createDataFrame(rows, "doc_id long, block_idx int, page_number int, start_offset int, end_offset int")
    probes = [(1, o) for o in range(-1, 130)] + [(2, 5), (1, 3)]
    got = {(r.doc_id, r.offset): r.block_idx for r in DOC.locate_offsets(spark.createDataFrame(probes, "doc_id long, offset int"), mapped).collect()}
    want = {(d, o): min((i for _, i, _, a, b in rows if d == 1 and a <= o <= b), default=None) for d, o in probes}
    assert got == want


def test_lookups_move_probes_and_blocks_once(spark):
    mapped = spark.createDataFrame(_spans(1, 30, True), "doc_id long, block_idx int, page_number int, start_offset int, end_offset int")
    probes = spark.createDataFrame([(1, 3)], "doc_id long, offset int")
    found = DOC.stabbed(probes, mapped, "offset", "start_offset", "end_offset", ["block_idx"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "BETWEEN" not in plan and plan.count("Join") == 1  # the one for clusters of several spans, by equal keys


def test_issues_meet_the_blocks_that_end_in_them(spark):
    rnd = random.Random(4)
    blocks = [(d, i, f"n{i}", a, a + rnd.randint(0, 5)) for d in (1, 2) for i, a in enumerate(rnd.choices(range(1, 40), k=25))]
    issues = [(d, k, a, a + rnd.randint(-1, 6)) for d in (1, 2, 3) for k, a in enumerate(rnd.choices(range(1, 45), k=20))]
    got = {(r.doc_id, r.seq): r.node_ids for r in DOC.evidence_blocks(
        spark.createDataFrame(issues, "doc_id long, seq int, line_start int, line_end int"),
        spark.createDataFrame(blocks, "doc_id long, block_idx int, node_id string, line_start int, line_end int")).collect()}
    want = {(d, k): sorted({n for e, _, n, x, y in blocks if e == d and (a <= x <= b or a <= y <= b)}) for d, k, a, b in issues}
    assert got == {k: v for k, v in want.items() if v}


def test_overlaps_of_nested_touching_and_equal_spans(spark):
    rows = [(1, 0, 10), (1, 2, 3), (1, 5, 6), (1, 10, 12), (1, 12, 15), (1, 12, 15), (2, 0, 5), (2, 5, 5), (2, 5, 9)]
    spans = spark.createDataFrame(rows, "doc_id long, start_offset int, end_offset int")
    lapped = sorted((r.doc_id, r.start_offset) for r in DOC.overlapping(spans).where("overlaps").collect())
    assert lapped == [(1, 2), (1, 5), (1, 12)]
    assert sorted((r.doc_id, r.start_offset) for r in DOC.overlapping(spans, previous_only=True).where("overlaps").collect()) == [(1, 2), (1, 12)]


def test_validation_of_an_empty_document(spark):
    docs = parse(spark.createDataFrame([(1, ""), (2, "x [1]")], "doc_id long, text string"))
    blocks = spark.createDataFrame([(2, 0, "paragraph", "x [1]", "n"), (2, 1, "table", "y", "n")], "doc_id long, block_idx int, type string, text string, node_id string")
    one, two = DOC.parse_validation(docs, blocks).orderBy("doc_id").collect()
    assert not one.valid and one.warnings == 1 and not one.has_content
    assert not two.unique_nodes and not two.valid and (two.tables, two.citations, two.has_node_ids, two.has_offset_map) == (1, 1, True, False)


TEXTS = ["", "short", "# A\n" + "one two. " * 60 + "\n## B\n\n" + "x" * 900 + "\n### C\ny\n" * 30, "é😀 " * 400, "a.\n\n\nb! " * 200, "\n" * 700, "pre\n# H\n# I\nbody"]


@pytest.mark.parametrize("size,overlap", [(600, 50), (700, 150), (40, 10), (50, 49)])
def test_chunks_cover_the_text_and_end_at_breaks(spark, size, overlap):
    rows = DOC.boundary_chunks(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), size, overlap).orderBy("doc_id", "chunk").collect()
    import re

    def cut(text):
        start, out = 0, []
        while True:
            end = min(start + size, len(text))
            if end < len(text):
                low = max(start + overlap + 1, end - 500)
                for p in (r"\n#{1,3}\s+[^\n]+\n", r"\n\n", r"\n", r"[.!?]\s+"):
                    if found := re.match(f"(?s)(.*{p})", text[low:end]):
                        end = low + len(found[1])
                        break
            out.append((start, end, text[start:end]))
            if end >= len(text):
                return out
            start = max(start + 1, end - overlap)

    for i, text in enumerate(TEXTS):
        assert [(r.start_char, r.end_char, r.chunk_text) for r in rows if r.doc_id == i] == cut(text)


def test_sections_and_fixed_windows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in DOC.section_chunks(docs, 300, 20).collect():
        assert r.chunk_text == TEXTS[r.doc_id][r.start_char : r.end_char]
    assert [(r.section, r.chunk_text) for r in DOC.section_chunks(docs.where("doc_id = 6")).orderBy("chunk").collect()] == [("document-start", "pre\n"), ("H", "# H\n"), ("I", "# I\nbody")]
    for size, overlap in ((7, 2), (10, 8), (1000, 100)):
        for r in DOC.fixed_chunks(docs, size, overlap).where("doc_id < 4").collect():
            text, at = TEXTS[r.doc_id], r.chunk * (size - overlap)
            assert (r.start_char, r.chunk_text) == (at, text[at : at + size]) and r.start_line == text[:at].count("\n") + 1 and r.end_line == text[: r.end_char].count("\n") + 1


def test_running_sums(spark):
    frame = spark.createDataFrame([([],), ([5],), (list(range(1, 200)),), (None,)], "v array<int>")
    from quillspark.functions import rx

    got = [r[0] for r in frame.select(rx.running(F.col("v"))).collect()]
    assert got == [[], [5], [sum(range(1, i + 1)) for i in range(1, 200)], None]
