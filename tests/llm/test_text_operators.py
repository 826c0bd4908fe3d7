"""Operators on documents against brute force, over odd texts: null, empty, blank, long, repeated, non-ASCII."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import minhash, ordinal, pitman_yor, profiles, suffixes, viterbi, wu_manber
from quillspark.llm.text import LOWER, NOT_BLANK, fingerprints, raw, slices, words

from . import cases

SCHEMA = "doc_id long, text string"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, cases.odd_texts()).cache()


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_words_of_slices(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for part in slices(batch, "text", limit):
        data, offsets = raw(part.column("text"))
        low = LOWER[data]
        starts, ends, doc = words(low, offsets, NOT_BLANK)
        assert len(set(fingerprints(low, starts, ends).tolist())) == len({low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})
        for d in range(part.num_rows):
            got.append([low[a:b].tobytes().decode() for a, b in zip(starts[doc == d], ends[doc == d], strict=True)])
    assert got == [cases.words(t) for t in texts]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(odd, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd, size, percent).collect()}
    assert got == dict(enumerate(cases.near(cases.odd_texts(), size, percent)))


def test_near_duplicates_across_pivots(spark):
    # a chain whose ends are no near copies, and groups that share a passage without being near
    base = cases.prose(11, 200).split(" ")
    chain = [" ".join(base[:150 + 4 * i][4 * i:]) for i in range(12)]
    shared = cases.prose(12, 40)
    texts = chain + [shared + " " + cases.prose(20 + i, 25) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert got == dict(enumerate(cases.near(texts, 3, 85)))


def test_near_duplicates_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "a b c d")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in got) == [
        (False, 0, 0, True), (False, 1, 0, False), (False, 1, 0, False), (True, 0, None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_match_threshold():
    assert minhash.matches_for(85, 32) == 16 and minhash.matches_for(80, 32) == 13


@pytest.mark.parametrize("group", [5000, 0])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)  # at 0 every key goes the way of large ones
    texts = [t for t in cases.odd_texts() if len(t or "") < 20_000]
    line = cases.prose(31, 45)
    texts += [cases.prose(40 + i, 30) + line + cases.prose(60 + i, 30) for i in range(8)]
    texts += [line[:199], line[:200], line[3:203]]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.without_repeats(frame(spark, texts)).drop("text").collect()}
    assert got == dict(enumerate(cases.repeats(texts, 200)))


def test_cut_texts(spark):
    texts = ["é" * 150 + "end", None, "short"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.n_removed) for r in suffixes.without_repeats(rows, text=True).collect()}
    assert got[1] == (None, 0) and got[2] == ("short", 0)
    assert got[0] == ("end", 300)
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contamination(spark, odd):
    texts = cases.odd_texts()
    long = texts[0].split(" ")
    items = [(1, " ".join(long[5:40])), (2, "One two"), (2, "three"), (3, None), (4, ""), (5, "!!"), (6, texts[12]), (7, "日本語"), (None, texts[0]), (10, " ".join(long[8:18]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(enumerate(cases.contaminated(texts, items, 10)))
    for per_pass in (200_000, 7):  # in one pass and in many
        got = wu_manber.contamination(odd, bench, per_pass=per_pass).drop("text").collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
    none = wu_manber.contamination(odd.withColumnRenamed("doc_id", "n_hit"), bench.limit(0)).collect()
    assert {r.contaminated for r in none} == {False} and none[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_language(spark):
    texts = {"aa": ["the cat and the dog", "and then the hen"], "bb": ["der hund und die katze", "und dann die henne"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    docs = spark.createDataFrame(rows + [(90, None, "aa"), (91, "the", None)], "doc_id long, text string, lang string")
    learned = profiles.learn(docs)
    probe = spark.createDataFrame([(0, "the THE hen", 7), (1, "die und der", 7), (2, None, 7), (3, "12 !?", 7), (4, "", 7), (5, "日本", 7)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in profiles.identify(probe, learned).collect()}
    assert [got[i][0] for i in range(5)] == ["aa", "bb", "und", "und", "und"] and got[2][1] == 0.0
    assert got[5] == ("aa", 0.0)  # a tie goes to the first name
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in profiles.identify(probe, learned.limit(0)).collect()} == {"und"}


def test_out_of_place_distance():
    own, counts = profiles.grams("Abba ba")
    text = "".join(" abba ba ")
    want = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            g = text[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                want[g] = want.get(g, 0) + 1
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    assert dict(zip(own.tolist(), counts.tolist(), strict=True)) == {code(g): c for g, c in want.items()}
    lang, score = profiles._nearest("Abba ba", ["x"], np.sort(own), np.full((own.size, 1), 600), 300)
    assert (lang, score) == ("x", 0.0)


def test_token_counts_follow_the_public_tokenizer(spark, odd):
    from tokenizers import Tokenizer, models

    v = viterbi.vocabulary(PIECES)
    table = [("<unk>", 0.0), *v.pieces.items(), *((f"<0x{b:02X}>", -1e9) for b in range(256))]
    exact = Tokenizer(models.Unigram(table, 0, byte_fallback=True))
    got = {r.doc_id: r.n_tokens for r in viterbi.token_counts(odd, PIECES).collect()}
    for i, text in enumerate(cases.odd_texts()):
        if text is None or len(text) > 20_000:
            continue
        whole = viterbi.SPACE + text.replace(" ", viterbi.SPACE) if text else ""
        parts = whole.replace("\n", "\0\n\0").split("\0")
        assert got[i] == sum(len(exact.encode(p, add_special_tokens=False).ids) for p in parts if p), text[:60]
    assert viterbi.token_counts(odd.limit(0), PIECES).count() == 0


@given(st.text(alphabet="abc ", max_size=30))
@settings(max_examples=80, deadline=None)
def test_viterbi_ties(text):
    from tokenizers import Tokenizer, models

    pieces = {"▁": -2.0, "a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, "▁a": -3.0, "bb": -2.5}
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, byte_fallback=False))
    whole = viterbi.SPACE + text.replace(" ", viterbi.SPACE)
    ids = exact.encode(whole, add_special_tokens=False).tokens
    # the public tokenizer joins neighbouring unknown characters
    want = sum(len(t) if t.strip("c") == "" else 1 for t in ids)
    assert viterbi.Counter(viterbi.Vocabulary(pieces, False)).text(text) == (want if text else 0)


def test_ordinal_grades(spark):
    texts = [cases.prose(100 + i, 60, 50) + {0: " scum trash", 1: " word%%% x%%%", 2: ""}[i % 3] for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    rated = spark.createDataFrame([(i, i % 3) for i in range(500)] + [(None, 1), (3, None), (5, 2)], "doc_id long, grade int")
    model = ordinal.learn(docs, rated, 3)
    got = {r.doc_id: r for r in ordinal.graded(docs.withColumnRenamed("doc_id", "kept").selectExpr("kept doc_id", "text", "1 kept"), model, 2).collect()}
    held = range(500, 600)
    assert np.mean([got[i].kept == (i % 3 == 2) for i in held]) > 0.9
    assert all(0 <= got[i].p_tail <= 1 and 0 <= got[i].expected_grade <= 2 for i in got)
    blank = ordinal.learn(docs, rated.limit(0), 3)
    assert not blank.weights.any()


def test_ordinal_gradient():
    # one step down the likelihood of a single feature moves its weight to the grade's side
    slots = [np.array([3], np.int32), np.array([5], np.int32)]
    model = ordinal.fit(slots * 20, np.array([0, 2] * 20), 3, 4)
    assert model.weights[3] < 0 < model.weights[5] and model.thresholds[0] <= model.thresholds[1]


def test_language_model(spark):
    texts = [t for t in cases.odd_texts() if len(t or "") < 20_000] + [cases.prose(200 + i % 5, 80, 60) for i in range(60)]
    docs = [(i, cases.remainder(i, 10) == 0, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, held_out boolean, text string")
    fitted = pitman_yor.fit(frame.where("NOT held_out"), sweeps=3)
    got = {r.doc_id: r for r in pitman_yor.scores(frame, fitted).collect()}
    n, want = cases.unigram([t for _, h, t in docs if not h], texts)
    for i, (tokens, known, base) in enumerate(want):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score < 0
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    # in every context the probabilities of all words and the unknown sum to one
    rows = fitted.model.collect()
    for cls in (0, 9, 100, 255):
        total = 0.0
        for row in rows:
            own = pitman_yor._opened(row.asDict())
            from_states = pitman_yor._load(row["states"])["sweeps"]
            held = own, [pitman_yor._probabilities(own.restore(s), t) for s, t in zip(from_states, fitted.samples, strict=True)]
            _, log = pitman_yor._replies(held, fitted.samples, own.words, np.ones(own.words.size, int), np.full(own.words.size, cls))
            total += (10.0**log).sum()
        _, log = pitman_yor._replies(None, fitted.samples, np.array([1], np.uint64), np.array([1]), np.array([cls]))
        assert math.isclose(total + 10.0 ** log[0], 1, rel_tol=1e-6)
    assert pitman_yor.scores(frame.limit(0), fitted).count() == 0
    empty = pitman_yor.scores(frame.limit(3), pitman_yor.fit(frame.limit(0))).collect()
    assert {r.score for r in empty} == {0.0} and {r.train_tokens for r in empty} == {0}


def test_language_model_tells_words_of_one_class_apart(spark):
    # two words before, of one class, are followed by different words; all words are equally frequent
    names = [f"w{i}ed" for i in range(200)]
    low = np.frombuffer(" ".join(names).encode(), np.uint8)
    word, cls, _ = pitman_yor.tokens(low, np.array([0, low.size]))
    one, two = (int(i) for i in np.flatnonzero(cls[:-1] == cls[0])[:2])
    a, b = names[one], names[two]
    train = [(i, False, f"{a} left {b} right") for i in range(50)]
    asked = [(100, True, f"{a} left {b} right"), (101, True, f"{a} right {b} left")]
    frame = spark.createDataFrame(train + asked, "doc_id long, held_out boolean, text string")
    fitted = pitman_yor.fit(frame.where("NOT held_out"))
    got = {r.doc_id: r.score for r in pitman_yor.scores(frame, fitted).collect()}
    assert got[100] > got[101] + 2
    # what follows a word, the end and the unknown included, sums to one
    own = [pitman_yor._opened(r.asDict()) for r in fitted.model.collect()]
    words = np.concatenate([np.unique(np.concatenate([x.words for x in own])), np.array([12345], np.uint64)])
    for context in (0, 1, 2):  # a known word, another, the unknown
        before = np.array([word[one], word[two], np.uint64(12345)])[context]
        asks = {}
        for b in np.unique(pitman_yor._bucket(words, fitted.buckets)).tolist():
            part = words[pitman_yor._bucket(words, fitted.buckets) == b]
            asks[b] = pitman_yor._dump(word=part, many=np.ones(part.size, np.uint8), context=np.array([before]), cls=cls[[one]].astype(np.uint8), at=np.zeros(part.size, np.uint8))
        table = spark.createDataFrame([(b, 0, bytearray(x)) for b, x in asks.items()], "bucket long, chunk long, blob binary")
        replies = [pitman_yor._load(r.blob) for r in pitman_yor._answered(table, fitted).orderBy("bucket").collect()]
        order = np.concatenate([words[pitman_yor._bucket(words, fitted.buckets) == b] for b in asks])
        count = np.concatenate([p["count"] for p in replies])
        at = int(np.flatnonzero(order == before)[0])
        total = 0.0
        for k, s in enumerate(fitted.samples):
            n, seated, chance, tables = (np.concatenate([p[x] if x == "n" else p[x][k] for p in replies]).astype(float) for x in ("n", "seated", "chance", "tables"))
            total += ((n - s.discounts[3] * seated + (s.strengths[3] + s.discounts[3] * tables[at]) * chance) / (s.strengths[3] + count[at])).sum()
        assert math.isclose(total / len(fitted.samples), 1, rel_tol=1e-5)


def test_seating_matches_the_expected_number_of_tables():
    # with one dish and a base of 1, tables follow the Pitman-Yor process
    from math import lgamma

    d, a, n = 0.5, 1.0, 40
    random = np.random.default_rng(3)
    tables = np.ones(4000, np.int64)
    for seated in range(1, n):
        tables += random.random(4000) < (a + d * tables) / (a + seated)
    want = a / d * (math.exp(lgamma(a + d + n) + lgamma(a) - lgamma(a + n) - lgamma(a + d)) - 1)
    assert abs(tables.mean() - want) < 0.2
    few = pitman_yor._tables(np.full(2000, 200), np.full(2000, 0.3), d, random)
    many = pitman_yor._tables(np.full(2000, 200), np.full(2000, 30.0), d, random)
    assert few.min() >= 1 and many.max() <= 200 and many.mean() > few.mean()
