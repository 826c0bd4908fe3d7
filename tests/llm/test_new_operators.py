"""Whitening, source divergence and sanitisation: brute force, odd input, and the registered SQL on planted tables."""

import collections
import itertools

import duckdb
import numpy as np
import pytest

from quillspark.llm import divergence, queries, sanitize, sql, whitening
from tests.compare import difference

from . import cases

SF = "/root/testdata/sf0.001"
ODD = ["", "one", "a" * 900, "ab" * 3000, "ÀÉ x À", "x\u0085y", "aaaaaaaa", "aaaaaaaab", "aaaaaaaa aaaaaaaa", "1 2 3", cases.prose(1, 3000, 50)]


@pytest.mark.parametrize("leaf", [1, 5, 4096])
def test_pointer_sort(monkeypatch, leaf):
    monkeypatch.setattr(divergence, "LEAF", leaf)
    data = np.frombuffer(" ".join([*ODD, *ODD]).encode(), np.uint8)
    start, end, _ = divergence.words(divergence.LOWER[data], np.array([0, data.size]), divergence.LETTERS)
    order, first = divergence.pointer_sort(divergence.LOWER[data], start, end)
    words = [divergence.LOWER[data][a:b].tobytes() for a, b in zip(start, end, strict=True)]
    got = [words[i] for i in order]
    assert got == sorted(words) and sorted(order) == list(range(len(words)))
    assert first.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def _documents():
    random = np.random.default_rng(3)
    rows = []
    for i in range(700):
        lang = ["en", "en", "fr", None, "zz"][i % 5]
        source = f"s{i % 7 if i % 3 else 0}" if i % 11 else None
        rows.append((i, " ".join(random.choice([f"w{chr(97 + k)}" for k in range(26)], 12)) + f" {lang}{'É' if i % 2 else ''}", lang, source))
    rows += [(900 + i, t, "en", "odd") for i, t in enumerate(ODD)] + [(950, None, "en", "empty"), (951, "solo", "xx", "one"), (952, None, None, None)]
    return rows + rows[:3]


def _tables(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n int, term string"), con


@pytest.mark.parametrize("side", [128, 2])
def test_divergence(spark, side):
    docs, con = _tables(spark, _documents())
    got = divergence.audit(docs.repartition(3), side=side)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert difference(got, con, sql.OP11) is None
    assert {r.part for r in got.where("lang = 'xx'").collect()} == set()
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_counts(spark):
    rows = _documents()
    docs, _ = _tables(spark, rows)
    want = collections.Counter()
    for _, text, lang, source in rows:
        for w in cases.words(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"):
            want[lang or "", source or "", w] += 1
    assert {(r.lang, r.source, r.term): r.n for r in divergence.term_counts(docs).collect()} == want


CARD, PHONE = "4111 1111-1111 1111", "+1 (499) 555-6503"


def _private():
    rows = [(i, f"Xantippe tells lorem{i} 😀 of kim.lee@mail.example.org, {PHONE}", None, None) for i in range(5)]
    rows += [(10 + i, f"lorem ipsum telling number{i} sit 10.0.0.{i} amet", None, None) for i in range(60)]
    odd = [None, "", "éfoo@x.y.z a.b@c.d@e.f @x.y x@y x@.z", "1.2.3.4.5 1.2.3.256 001.02.3.4 1.2.3.0000000255 99999999999.1.1.1", f"{CARD} 4111111111111112 {CARD}4",
           "+123 +1234567890 +1 (2) 3-4.5 67890 1 +12345678901234567 +1 ", "+1" + " " * 500, "a" * 3000 + "@", "x@" + ".a" * 4000, "x@a" + ".a" * 4000, "9" * 3000,
           "9 " * 3000, ". " * 800, "xantippe alone", "a@b.c " * 300, " +1 499 555 6503\u0085", f"see {PHONE} at A@B.CO", f"see {PHONE} at a@b.co"]
    rows += [(100 + i, t, None, None) for i, t in enumerate(odd)]
    return rows + rows[:2] + rows[:1] + [(None, rows[0][1], None, None), (0, "another text of doc 0", None, None)]


def test_sanitised(spark):
    docs, con = _tables(spark, _private())
    got = sanitize.sanitised(docs.withColumn("base", docs["text"]).withColumn("spans", docs["doc_id"]).repartition(3)).cache()
    assert difference(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"), con, sql.OP12) is None
    one = got.where("doc_id = 1").first()
    assert "removed:0:8" in one.spans and one.clean_text == "[TERM] tel* lorem1 [TERM] [TERM] [EMAIL], [PHONE]"
    alone = got.where("text = 'xantippe alone'").first()
    assert alone.spans == "" and alone.clean_text == alone.text and got.where("text IS NULL").first().clean_text is None
    assert sanitize.sanitised(docs.limit(0)).count() == 0


def test_sanitised_without_python(spark):
    plan = queries.op12_information_sanitisation(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_characteristic_polynomial(spark):
    random = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (5, 3), (6, 6)):
        a = random.integers(-50, 50, (d, rank)).astype(object)
        m = (a @ a.T).tolist()
        got = whitening.characteristic(spark, m)
        for x in (-3, 0, 7, 10**6):
            assert sum(c * x ** (d - i) for i, c in enumerate(got)) == _determinant([[x * (i == j) - m[i][j] for j in range(d)] for i in range(d)])
    assert whitening.polynomial_modulo([[0, 1], [0, 0]], 7).tolist() == [1, 0, 0]


def _determinant(m):
    return sum((-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) * int(np.prod([m[i][p[i]] for i in range(len(p))], dtype=object))
               for p in itertools.permutations(range(len(m))))


def test_roots():
    # (x - 5)**2 (x - 3) x**2 and (x**2 - 10 x + 1)
    assert [(round(a / 2**k, 12), t) for a, k, t in whitening.largest_roots([1, -13, 55, -75, 0, 0], 16)] == [(5.0, 2), (3.0, 1)]
    (a, k, _), (b, n, _) = whitening.largest_roots([1, -10, 1], 16)
    assert abs(a / 2**k - (5 + 24**0.5)) < 1e-14 and abs(b / 2**n - (5 - 24**0.5)) < 1e-15
    assert whitening.largest_roots([1, -10, 1], 1) == [(a, k, 1)] and whitening.largest_roots([1, 0, 0], 3) == []


def _whitened(spark, rows, **more):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component string")
    return whitening.whitened(table.repartition(3), **more).collect()


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e14])
def test_whitening(spark, scale):
    random = np.random.default_rng(4)
    x = random.normal(size=(40, 5)) * [4, 3, 2, 1, 0.5] * scale
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[0].tolist()), (0, x[1].tolist()), (None, x[2].tolist())]
    odd = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5)]
    got = _whitened(spark, rows + odd, most=4)
    whole = [tuple(int(v) for v in np.floor(np.clip(np.array(r) * 64, -whitening.LIMIT, whitening.LIMIT))) for _, r in rows]
    fit = sorted(set(whole))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, total, strict=True)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    for i, (key, _) in enumerate(rows):
        exact = sum((n * a - s) ** 2 for a, s in zip(whole[i], total, strict=True))
        own = sorted((r for r in got if r.vec_id == key and r.deviation_exact == exact), key=lambda r: r.component)
        assert [r.component for r in own] == [1, 2, 3, 4] and {r.deviation for r in own} == {exact if exact < 2**63 else None}
        off = np.array([float(n * a - s) / n for a, s in zip(whole[i], total, strict=True)])
        assert np.allclose(np.abs([r.whitened for r in own]), np.abs(off @ u[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])), atol=1e-6)
        assert np.allclose([r.explained for r in own], e[::-1][:4] / e.sum(), rtol=1e-9)


def test_whitening_of_flat_and_equal_spaces(spark):
    # two equal eigenvalues and a flat dimension; a lone width; two vectors of another width
    square = [(i, [float(a), float(b), 1.0]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = _whitened(spark, [*square, (9, [1.0]), (10, [1.0, 2.0]), (11, [3.0, 2.0])])
    assert sorted((r.vec_id, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (10, 1), (11, 1)]
    assert all(r.identity_error < 1e-12 for r in got) and all(abs(r.explained - (0.5 if r.vec_id < 9 else 1)) < 1e-12 for r in got)
    assert _whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and _whitened(spark, []) == []
