"""Small tables with every odd case, and brute-force answers in plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np

BLANKS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, pattern=BLANKS):
    return re.findall(pattern, lower(text))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    random = np.random.default_rng(seed)
    stock = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyzéßñ"), random.integers(2, 9))) for _ in range(vocabulary)]
    return " ".join(random.choice(stock, n))


def edited(text: str, every: int) -> str:
    return " ".join("x" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def odd_texts() -> list[str | None]:
    base, other = prose(1, 300), prose(2, 120)
    passage = prose(3, 60)
    return [
        base, base, edited(base, 100), edited(base, 9), None, "", "   \t\n ", "one", "one two", "ONE two", "one two three", "!!! ???",
        other + " " + passage, passage + " " + prose(4, 90), "a" * 900, "ab" * 500, prose(5, 30_000, 5000), "é" * 150 + prose(6, 40),
        prose(7, 50).upper(), " x　y", "日本語 のテキスト です", prose(8, 80) + "\n" + prose(8, 80)]


def components(n: int, links) -> list[int]:
    label = list(range(n))
    while True:
        new = list(label)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


def near(texts, size, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(len(s), c) for s, c in zip(sets, components(len(sets), links), strict=True)]


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def contaminated(texts, items, size):
    patterns = collections.defaultdict(set)
    for item, t in items:
        w = words(t, ALNUM)
        for k in range(max(1, len(w) - size + 1)) if w and item is not None else ():
            patterns[tuple(w[k : k + size])].add(str(item))
    out = []
    for t in texts:
        w, hit, named = words(t, ALNUM), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if (found := patterns.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    named |= found
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def unigram(train, texts):
    tokens = lambda t: [*words(t), None]
    c = collections.Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for t in texts]


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
