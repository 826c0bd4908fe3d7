"""Diffs leave a worker in slices: what it holds does not grow with the documents of a batch."""

import pyarrow as pa

from quillspark.operators import fix as FX


class Frame:
    """Stands for a frame of document pairs that come in one Arrow batch."""

    def __init__(self, *rows):
        self.batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "text", "fixed_text"])

    def select(self, *columns):
        return self

    def mapInArrow(self, step, schema):
        return list(step([self.batch]))


def test_word_diff_leaves_in_slices():
    slices = FX.diffs(Frame(*[(i, "a b c " * 50, "a b d " * 50) for i in range(300)]), "word")
    rows = [r for s in slices for r in s.to_pylist()]
    assert len(slices) > 1 and max(s.num_rows for s in slices) <= FX.ROWS
    assert rows == [dict(zip(slices[0].schema.names, r)) for i in range(300) for r in FX.diff_rows(i, "a b c " * 50, "a b d " * 50, "word")]


def test_paragraph_diff_of_long_texts_leaves_in_slices():
    long = "word " * 60_000
    slices = FX.diffs(Frame(*[(i, f"{long}\n\nold", f"{long}\n\nnew") for i in range(12)]), "paragraph")
    assert len(slices) == 7 and sum(s.num_rows for s in slices) == 36
    assert [r["kind"] for r in slices[0].to_pylist()][:3] == ["same", "removed", "added"]


def test_unified_diffs_leave_in_slices():
    text = "".join(f"line {i} {'x' * 90}\n" for i in range(2000))
    slices = FX.unified_diffs(Frame(*[(i, text, text.replace("line", "row")) for i in range(8)]))
    assert [s.num_rows for s in slices] == [3, 3, 2]
    assert {(r["changes"], r["additions"], r["deletions"]) for s in slices for r in s.to_pylist()} == {(4000, 2000, 2000)}
