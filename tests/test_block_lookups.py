"""Jump targets and evidence blocks: rows moved, and issues and blocks of any lines."""

from quillspark.operators import document as DOC

BLOCKS = "doc_id long, block_idx int, page_number int, node_id string, line_start int, line_end int"
ISSUES = "doc_id long, seq int, line_start int, line_end int"


def tables(spark):
    blocks = [(1, 0, 1, "a", 1, 2), (1, 1, 1, "b", 3, 3), (1, 2, 1, "c", 5, 9), (2, 0, 1, "d", 1, 1), (3, 7, 2, "e", 4, 6), (3, 8, 2, None, 5, 5)]
    issues = [(1, 0, 1, 9), (1, 1, 4, 4), (1, 2, 6, 7), (1, 3, 9, 9), (2, 0, 2, 2), (3, 0, 5, 5), (3, 1, 4, 6), (9, 0, 1, 1)]
    return spark.createDataFrame(issues, ISSUES), spark.createDataFrame(blocks, BLOCKS)


def test_jump_targets_read_their_sides_once(spark):
    found = DOC.jump_targets(*tables(spark))
    assert {(r.doc_id, r.seq, r.block_idx, r.target_start, r.target_end) for r in found.collect()} == {
        (1, 0, 0, 1, 2), (1, 2, 2, 6, 7), (1, 3, 2, 9, 9), (3, 0, 7, 5, 5), (3, 1, 7, 4, 6)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Relation" in plan


def test_evidence_blocks_move_no_matches(spark):
    found = DOC.evidence_blocks(*tables(spark))
    assert {(r.doc_id, r.seq): r.node_ids for r in found.collect()} == {
        (1, 0): ["a", "b", "c"], (1, 3): ["c"], (3, 1): ["e"]}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
