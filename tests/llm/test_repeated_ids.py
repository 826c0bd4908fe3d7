"""Rows that repeat an id with other content, columns of any name, ids of any type, damaged headers, bounded passes."""

import gzip
import io

import corpus_pipeline
import pytest
from quillspark.llm import lattice, minhash, mixture, suffixes, warc, wu_manber
from quillspark.llm.text import unpacked

from . import cases

A, B = cases.prose(11, 120), cases.prose(12, 120)
TEXTS = [(1, A), (1, B), (2, A + " word"), (3, B + " word"), (4, A), (4, cases.prose(13, 80)), (None, A), (5, None), (5, ""), (6, B), (6, B)]


def test_texts_of_one_id_link_by_themselves(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    # brute force over rows, ids only at the end
    rows = [i for i, (d, _) in enumerate(TEXTS) if d is not None]
    label = [c for _, c in cases.near([TEXTS[i][1] for i in rows], 5, 80)]
    least = {c: min(TEXTS[rows[k]][0] for k, x in enumerate(label) if x == c) for c in label}
    want = sorted((TEXTS[i][0], least[label[k]]) for k, i in enumerate(rows))
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_pipeline_keeps_other_texts_of_an_id(spark):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, A), (1, B), (4, TEXTS[5][1]), (None, A), (5, None), (5, "")], key=str)


def test_vectors_of_one_id_count_by_themselves(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.0, 1.0, 0.01], 0), (3, [0.0, 0.0, 1.0], 0), (None, [0.0, 0.01, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(table).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 3, True), (None, 1, 3, True)], key=str)


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(9,0)"])
def test_repeats_for_ids_and_columns_of_any_name(spark, kind):
    texts = [A + B, "x" + A, None, B + "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        f"cast(doc_id AS {kind}) doc_id", "text", "doc_id rid", "'s' spans", "1 key", "2 `a.b`")
    got = suffixes.without_repeats(docs).orderBy("rid").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == cases.repeats(texts, 200)
    assert [(r.rid, r.spans, r.key, r["a.b"]) for r in got] == [(i, "s", 1, 2) for i in range(4)]


def test_mixture_for_columns_of_any_name(spark):
    plain = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i % 7)) for i in range(60)], "doc_id long, source string, text string")
    clashing = plain.selectExpr("*", *(f"'u' {c}" for c in ("tokens", "part", "before", "epochs", "n_blocks", "running", "_source", "_block", "weight", "n")))
    key = lambda r: (r.doc_id, r.epoch, r.block, r.place)
    rows = mixture.mixed(clashing).collect()
    assert sorted(map(key, rows)) == sorted(map(key, mixture.mixed(plain).collect()))
    assert rows and {r.before for r in rows} == {r.tokens for r in rows} == {"u"}


def test_patterns_in_several_passes(spark):
    items = [(f"i{k}", cases.prose(20 + k, 30)) for k in range(6)] + [(None, A)]
    texts = [items[0][1] + " " + B, B, None, items[3][1] + " " + items[5][1], A]
    docs = spark.createDataFrame([(i, t, "u", "v") for i, t in enumerate(texts)], "doc_id long, text string, _spans string, _items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = cases.contaminated(texts, items, 10)
    for per_pass in (200_000, 40):
        got = wu_manber.contamination(docs, bench, per_pass=per_pass).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == want
        assert [(r["_spans"], r["_items"]) for r in got] == [("u", "v")] * 5


def test_damaged_headers_are_passed_over():
    def member(length, page="7"):
        return gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: {page}\r\nContent-Length: {length}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n".encode())

    whole = member("x") + member("-1") + member(9999) + member("9" * 40) + member(21) + member(21, "seven") + member(21, "9" * 30)
    found = list(warc.members(io.BytesIO(whole), 0, len(whole), len(whole)))
    assert [(r[2], r[-1]) for r in found] == [(7, b"hi"), (None, b"hi"), (None, b"hi")]


def test_unpacked_ranges():
    import pyarrow as pa
    import zstandard

    texts = ["a" * 10, None, "b" * 95, "é" * 100, "", "c"]
    column = pa.array([None if t is None else zstandard.compress(t.encode()) for t in texts])
    ranges = list(unpacked(column, 100))
    assert [t for _, _, part in ranges for t in part] == texts
    assert [(a, b) for a, b, _ in ranges] == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(unpacked(column.slice(0, 0))) == []
