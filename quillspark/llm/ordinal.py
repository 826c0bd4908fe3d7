"""Quality grades by ordinal cumulative-link regression on hashed text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALPHANUMERIC, LOWER, NOT_BLANK, bounds, fingerprints, raw, slices, words

#: Kinds of bytes for the shape of a token: lower case and all longer characters, upper case, digits, else the byte itself.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features present in each whole text, end to end, and the offset of each text: its words, and the shapes of its tokens."""
    data, offsets = raw(column)
    n = len(column)
    low = LOWER[data]
    starts, ends, doc = words(low, offsets, ALPHANUMERIC)
    prints = fingerprints(low, starts, ends)
    kind = _KIND[data]
    first, last, of = words(data, offsets, NOT_BLANK)
    changed = np.ones(kind.size, bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed[first] = True
    at = np.concatenate([[0], np.cumsum(changed)])
    shapes = fingerprints(kind[changed], at[first], at[last]) ^ np.uint64(1)
    slot = np.concatenate([prints, shapes]) >> np.uint64(64 - bits)
    both = np.unique((np.concatenate([doc, of]).astype(np.uint64) << np.uint64(bits)) | slot)
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), bounds(both >> np.uint64(bits), n)


@dataclass
class Model:
    """P(grade >= k) = logistic(score - thresholds[k - 1]); the score is the sum of the weights of the features present."""

    bits: int
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, column: pa.Array) -> np.ndarray:
        slots, at = features(column, self.bits)
        total = np.concatenate([[0.0], np.cumsum(self.weights[slots])])
        score = total[at[1:]] - total[at[:-1]]
        return _logistic(score[:, None] - self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(slots: list[np.ndarray], grades: np.ndarray, levels: int, bits: int, epochs: int = 12, step: float = 0.15, penalty: float = 0.08, seen_in: int = 4) -> Model:
    """Proportional-odds likelihood by adaptive gradient steps over small batches, in an order set by a fixed seed.

    An absolute penalty on each weight a step keeps features at 0 that do not pay: in a long text many would add up.
    Features in fewer than `seen_in` of the documents keep weight 0: they tell documents apart, not grades.
    """
    often = np.bincount(np.concatenate([*slots, np.zeros(0, np.int32)]).astype(np.int64), minlength=1 << bits) >= seen_in
    slots = [own[often[own]] for own in slots]
    weights, thresholds = np.zeros(1 << bits), np.linspace(-1.0, 1.0, levels - 1)
    seen, seen_t = np.full(1 << bits, 1e-2), np.full(levels - 1, 1e-2)
    order = np.random.default_rng(7)
    for _ in range(epochs if len(slots) else 0):
        for part in np.array_split(order.permutation(len(slots)), max(1, len(slots) // 32)):
            flat = np.concatenate([slots[i] for i in part])
            of = np.repeat(np.arange(part.size), [slots[i].size for i in part])
            score = np.bincount(of, weights[flat], part.size)
            y = grades[part]
            upper = np.where(y == 0, 1.0, _logistic(score - thresholds[np.maximum(y - 1, 0)]))
            lower = np.where(y == levels - 1, 0.0, _logistic(score - thresholds[np.minimum(y, levels - 2)]))
            d_upper, d_lower, p = upper * (1 - upper), lower * (1 - lower), np.maximum(upper - lower, 1e-9)
            pull = (d_upper - d_lower) / p  # of the log-likelihood, by the score
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, pull[of], touched.size)
            seen[touched] += g * g
            pace = step / np.sqrt(seen[touched])
            moved = weights[touched] + pace * g
            weights[touched] = np.sign(moved) * np.maximum(0, np.abs(moved) - pace * penalty)
            g = np.bincount(np.maximum(y - 1, 0), np.where(y > 0, -d_upper / p, 0), levels - 1)
            g += np.bincount(np.minimum(y, levels - 2), np.where(y < levels - 1, d_lower / p, 0), levels - 1)
            seen_t += g * g
            thresholds = np.maximum.accumulate(thresholds + step * g / np.sqrt(seen_t))
    return Model(bits, weights, thresholds)


def learn(docs: DataFrame, rated: DataFrame, levels: int, bits: int = 18, sample: int = 20_000) -> Model:
    """A model from rated (doc_id, grade 0 to levels - 1). At most `sample` rated documents are used, by the order of a hash of doc_id.

    Rows with a null id or grade are left out; of several grades of a document the lowest counts. Without any rated
    document all weights are 0. The documents used (a bounded number) are featurized by tasks and fitted on the driver.
    """
    graded = rated.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def featured(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                slots, at = features(part.column("text"), bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("grade"), pa.array([slots[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["grade", "slots"])

    used = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").selectExpr("cast(grade AS int) grade", "text")
    rows = sorted((r.grade, bytes(r.slots)) for r in used.mapInArrow(featured, "grade int, slots binary").toLocalIterator())
    return fit([np.frombuffer(s, np.int32) for _, s in rows], np.array([g for g, _ in rows], np.int64), levels, bits)


def graded(docs: DataFrame, model: Model, at_least: int, keep: float = 0.5) -> DataFrame:
    """Every row of docs with expected_grade, p_tail (of grade `at_least` or better) and kept (p_tail >= keep) appended.

    Columns of these names are replaced. Null and empty texts have no features: thresholds alone decide. Repeated rows
    are graded alike.
    """
    docs = docs.drop("expected_grade", "p_tail", "kept")
    table = docs.sparkSession.sparkContext.broadcast(model)

    def grade(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                tails = table.value.tails(part.column("text"))
                p = tails[:, at_least - 1]
                for name, x in (("expected_grade", tails.sum(1)), ("p_tail", p), ("kept", p >= keep)):
                    part = part.append_column(name, pa.array(x))
                yield part

    return docs.mapInArrow(grade, docs.withColumns({"expected_grade": F.lit(0.0), "p_tail": F.lit(0.0), "kept": F.lit(False)}).schema)
