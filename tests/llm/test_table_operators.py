"""Vectors, archives, mixtures, the pipeline and the registered SQL."""

import gzip
import io
import math

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import lattice, mixture, queries, registry, sql, warc
from quillspark.llm.store import fresh
from tests.compare import difference, oracle

from . import cases

SF = "/root/testdata/sf0.001"


def test_lattice_points():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 3
    points = lattice.decode(x)
    assert len(lattice.MINIMAL) == 240 and ((lattice.MINIMAL**2).sum(1) == 2).all()
    nearest = ((x[:, None] - (points[:, None] + lattice.MINIMAL)) ** 2).sum(2).min(1)
    assert (((x - points) ** 2).sum(1) <= nearest + 1e-9).all()


@pytest.mark.parametrize("side", [1024, 4])
def test_vectors(spark, side):
    random = np.random.default_rng(5)
    base = random.normal(size=(60, 16))
    rows = [[float(v) for v in x] for x in np.concatenate([base, base[:30] + random.normal(size=(30, 16)) * 0.05, base[:12] * 3, np.repeat(base[:1], 15, 0)])]
    label = [None if i % 17 == 16 else i % 2 if i < 60 else (i - 60) % 2 if i < 90 else (i - 90) % 2 if i < 102 else 0 for i in range(len(rows))]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 0.0], [2.0, -0.0], [1e200] * 16, [1e-200] * 16]
    label += [0] * 10
    table = spark.createDataFrame([(i, v, c, "x") for i, (v, c) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<double>, label int, links string")
    unit = [None if not v or label[i] is None or any(x is None or not math.isfinite(x) for x in v) or not any(v)
            else np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for i, v in enumerate(rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None
             and label[i] == label[j] and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.93]
    n = np.bincount(np.array(links).ravel(), minlength=len(rows)).tolist()
    group = cases.components(len(rows), links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(table, side=side).collect()}
    assert got == {i: (n[i], group[i], group[i] == i) for i in range(len(rows))}
    assert lattice.near_duplicates(table.limit(0)).count() == 0


def test_vector_recall():
    """Pairs at the threshold itself meet in a cell at least nine times in ten."""
    random = np.random.default_rng(1)
    x = random.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = random.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    a, b = (lattice.cells(v, 6, 2, 2.5, 2, 11) for v in (x, 0.93 * x + math.sqrt(1 - 0.93**2) * off))
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() >= 0.99


def _at_cosine(width, n, cosine):
    random = np.random.default_rng(2)
    x = random.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = random.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * off


@pytest.mark.parametrize("width", [2, 8, 12, 16, 24, 32])
def test_vector_recall_of_narrow_vectors(width):
    a, b = (lattice.cells(v, 6, 2, lattice.scale_for(width, 0.93, 2.5), 2, 11) for v in _at_cosine(width, 2000, 0.93))
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.99
    assert lattice.scale_for(64, 0.93, 2.5) == 2.5


def test_narrow_vectors_link(spark):
    rows = np.concatenate(_at_cosine(8, 300, 0.931))
    # each pair has a label of its own
    table = spark.createDataFrame([(i, v.tolist(), i % 300) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    assert lattice.near_duplicates(table).where("n_links = 1").count() >= 2 * 300 * 0.99


PAGES = [(1, "http://a/", "same"), (3, "http://b/\r\nx y", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 9),
         (7, "u", "x" * 300_000), (None, "u", "same"), (8, "u", "\x1f\x8b\x08 WARC/1.1"), (8, "u", "\x1f\x8b\x08 WARC/1.1")]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    newest = {"same": 3, "": 5}
    want = []
    for page_id, _, html in PAGES:
        body = html or ""
        again = page_id is not None and newest.get(body, page_id) != page_id
        want.append((page_id or 0, len(body.encode()), warc.digest(body.encode()), "revisit" if again else "response", newest[body] if again else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3]))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ranges_own_each_record_once():
    random = np.random.default_rng(2)
    bodies = [random.bytes(int(n)) for n in random.integers(0, 3000, 40)]
    whole = b"\x1f\x8b\x08junk" + b"".join(warc.record(i, "u", b, None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)) + warc.MAGIC
    for split in (1, 7, 100, 5000, 10**6):
        found = []
        for begin in range(0, len(whole), split) if split > 7 else range(0, 4000, split):
            found += [(r[2], r[-1]) for r in warc.members(io.BytesIO(whole), begin, min(begin + split, len(whole)), len(whole))]
        assert found == list(enumerate(bodies))[: len(found)] and (split <= 7 or len(found) == 40)
    assert gzip.decompress(warc.record(1, "u", b"p", None, "d")).startswith(b"WARC/1.1\r\n")


def test_reader_takes_any_archive(spark):
    spark.range(1).write.parquet(fresh(spark, "folder"))  # the shared folder exists
    from quillspark.llm.store import opened, shared

    store, place = opened(f"{shared(spark)}/plain.warc.gz")
    member = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    with store.open_output_stream(place, compression=None) as out:
        out.write(member + b"damaged" + member)
    archives = spark.createDataFrame([(f"{shared(spark)}/plain.warc.gz", 2 * len(member) + 7)], "path string, bytes long")
    assert [(r.warc_type, r.page_id, r.payload) for r in warc.read(archives, 16).collect()] == [("warcinfo", None, None)] * 2


def mixture_weights(shares, budget, entropy, repeats):
    """The exponent by a fine grid instead of bisection."""
    total = sum(shares)
    p = np.array([s / total for s in shares])
    best = None
    for e in np.linspace(1, 0, 20001):
        w = p**e / (p**e).sum()
        if -(w * np.log(w)).sum() >= entropy * np.log(len(p)) - 1e-12:
            best = e
            break
    if max(p**best / (p**best).sum() / p) * budget > repeats * total:
        best = next(e for e in np.linspace(best, 1, 20001) if max(p**e / (p**e).sum() / p) * budget <= repeats * total or e == 1)
    return p**best / (p**best).sum()


@pytest.mark.parametrize("entropy,repeats", [(0.0, 4.0), (0.9, 4.0), (1.0, 1.5), (1.0, 100.0)])
def test_mixture(spark, entropy, repeats):
    docs = [(s * 1000 + i, name, " ".join(["w"] * (1 + (i * 7) % 13)), 5) for s, (name, n) in enumerate([("a", 200), ("b", 60), ("c", 9), (None, 20)]) for i in range(n)]
    docs += [(9000, "zero", None, 5), (9001, "zero", "", 5), (9002, "a", None, 5), (7, "a", "w " * 3, 5)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, epoch int")
    got = mixture.mixed(frame, entropy=entropy, repeats=repeats).collect()
    own = {}
    for _, s, t, _ in docs:
        own[s] = own.get(s, 0) + len((t or "").split())
    total = sum(own.values())
    names = sorted((s for s in own if own[s]), key=lambda s: s or "")
    want = dict(zip(names, mixture_weights([own[s] for s in names], total, entropy, repeats), strict=True))
    longest = max(len((t or "").split()) for _, _, t, _ in docs)
    for s in names:
        tokens = sum(r.n_tokens for r in got if r.source == s)
        assert want[s] * total - longest - 0.02 * total <= tokens <= want[s] * total + 0.002 * total
        whole = math.floor(want[s] * total / own[s] - 0.01)
        for r in docs:
            if r[1] == s:
                epochs = [g.epoch for g in got if g.doc_id == r[0]]
                assert len(set(epochs)) >= whole and max(epochs, default=0) <= whole + 1
    assert "zero" not in {r.source for r in got}
    assert mixture.mixed(frame.limit(0)).count() == 0


def test_mixture_runs_without_python(spark):
    plan = queries.op8_temperature_mixture(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", sorted(sql.oracles()))
def test_same_rows_as_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), oracle(SF), sql.oracles()[name]) is None


def test_each_number_is_registered():
    names = registry.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark):
    base = cases.prose(1, 200)
    passage = cases.prose(2, 55)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = {
        0: base, 1: base, 2: cases.edited(base, 190), 3: None, 4: "!! 12", 5: cases.prose(3, 90) + " " + passage + ".", 6: passage + ", " + cases.prose(4, 90),
        7: cases.prose(5, 30) + " " + bench + " " + cases.prose(6, 30), 8: cases.prose(7, 120), 9: cases.prose(8, 100)}
    docs = spark.createDataFrame([(i, t, "aa", "s", 0, "more") for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    left = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        left.append(sorted({r.doc_id for r in docs.collect()}))
        if len(left) < len(corpus_pipeline.STAGES):
            assert docs.columns == corpus_pipeline.COLUMNS
        if len(left) == 3:
            kept = {r.doc_id: r.text for r in docs.collect()}
            assert passage not in kept[5] and passage not in kept[6] and kept[8] == texts[8]
    assert left[0] == [0, 1, 2, 5, 6, 7, 8, 9] and left[1] == [0, 5, 6, 7, 8, 9] == left[2]
    assert left[3] == [0, 5, 6, 8, 9] and set(left[4]) <= set(left[3])
