"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import released, slices

EDGE = 32  # stands for everything that is no letter; a run of it is one
_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams of one to three characters (lower-cased letters and word edges), as 21 bits a character, with their counts."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return none, none
    one = np.where(letter, points, EDGE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    one = np.concatenate([[EDGE], one[keep], [EDGE]])
    two = (one[:-1] << 21) | one[1:]
    three = (two[:-1] << 21) | one[2:]
    return np.unique(np.concatenate([one[one != EDGE], two[two != (EDGE << 21 | EDGE)], three[one[1:-1] != EDGE]]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, ties by n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, size: int = 300) -> DataFrame:
    """(lang, gram, place): the `size` most frequent n-grams of each language over all whole texts with a non-null lang."""

    def counted(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.setdefault(lang, []).append(grams(text))
                held = {lang: [_added(own)] for lang, own in held.items()}
        for lang, own in held.items():
            keys, counts = _added(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * keys.size, pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    counts = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(released(counted), "lang string, gram long, n long")
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            .withColumn("place", F.row_number().over(by)).where(F.col("place") <= size).select("lang", "gram", "place"))


def _added(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in own]), keys.size).astype(np.int64)


def identify(docs: DataFrame, profiles: DataFrame, size: int = 300) -> DataFrame:
    """Every row of docs with lang_pred and score appended; columns of these names are replaced.

    A text's `size` most frequent n-grams are compared with each profile: an n-gram costs the difference of the two
    places, or `size` where the profile lacks it. The nearest language wins, ties by name; score is 1 less the mean cost
    over `size`. Null texts and texts without a letter, and every text if nothing was learned, get `und` and 0.
    The profiles (`size` rows a language) go to the tasks as one small table.
    """
    docs = docs.drop("lang_pred", "score")
    rows = profiles.collect()
    langs = sorted({r.lang for r in rows})
    keys = np.unique(np.array([r.gram for r in rows], np.int64))
    places = np.full((keys.size, len(langs)), 2 * size, np.int32)
    for r in rows:
        places[np.searchsorted(keys, r.gram), langs.index(r.lang)] = r.place - 1
    table = docs.sparkSession.sparkContext.broadcast((langs, keys, places))

    def predict(batches):
        langs, keys, places = table.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = [_nearest(text, langs, keys, places, size) for text in part.column("text").to_pylist()]
                part = part.append_column("lang_pred", pa.array([x for x, _ in found], pa.string()))
                yield part.append_column("score", pa.array([s for _, s in found], pa.float64()))

    return docs.mapInArrow(released(predict), docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def _nearest(text, langs, keys, places, size):
    own = ranked(*grams(text), size)
    if not own.size or not langs:
        return "und", 0.0
    at = np.minimum(np.searchsorted(keys, own), keys.size - 1)
    cost = np.abs(places[at] - np.arange(own.size)[:, None])
    cost[(keys[at] != own)[:, None] | (places[at] == 2 * size)] = size
    total = cost.sum(0)
    best = int(total.argmin())
    return langs[best], float(1 - total[best] / (size * own.size))
