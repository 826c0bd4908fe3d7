"""Large groups of near copies: few pairs are left for the exact join, and none is lost."""

import random

from quillspark.llm import minhash


def _copies() -> list[str]:
    """Texts of one base: few have one word changed, most have three. Only a text of the first kind is similar enough to others."""
    rng, base = random.Random(5), [f"w{i}" for i in range(150)]
    texts = []
    for i in range(80):
        own = list(base)
        for j, at in enumerate(rng.sample(range(5, 145), 1 if i % 10 == 0 else 3)):
            own[at] = f"x{i}y{j}"
        texts.append(" ".join(own))
    return texts


def _linked(texts: list[str]) -> list[int]:
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    least = list(range(len(sets)))
    while True:
        new = [min(least[j] for j in range(len(sets)) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in range(len(sets))]
        if new == least:
            return least
        least = new


def test_few_pairs_of_a_large_group_reach_the_exact_join(spark, monkeypatch):
    texts, left, across = _copies(), [], minhash._across

    def counted(*args):
        pairs = across(*args)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_across", counted)
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, percent=85).collect()
    assert [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)] == _linked(texts)
    assert left[0] < 4 * len(texts)


def test_texts_with_a_common_passage_are_not_tried_by_every_list(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(100))
    texts, tried, guesses = [f"{passage} " + " ".join(f"x{i}y{j}" for j in range(40)) for i in range(60)], [], minhash._guesses

    def counted(*args):
        pairs = guesses(*args)
        tried.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_guesses", counted)
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted(r.component_id for r in rows) == list(range(60))
    assert tried and sum(tried) < len(texts)
