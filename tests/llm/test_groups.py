"""Runs of keys across batches."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.groups import runs, whole_runs


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=6), max_size=6))
def test_runs(parts):
    keys = sorted(k for part in parts for k in part)
    batches, at = [], 0
    for part in parts:
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + len(part)], pa.int64())], ["k"]))
        at += len(part)
    want = [[k] * keys.count(k) for k in sorted(set(keys))]
    assert [t.column("k").to_pylist() for t in runs(iter(batches), ["k"])] == want
    found = [t.column("k").to_pylist() for t in whole_runs(iter(batches), "k", 2)]
    assert [k for t in found for k in t] == keys
    assert all(not set(a) & set(b) for a, b in zip(found[:-1], found[1:], strict=True))
