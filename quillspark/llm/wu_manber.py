"""Benchmark decontamination by multi-pattern search over words (Wu-Manber).

A pattern is a window of `size` consecutive words of an item; an item of fewer words is one pattern. Patterns of one
length are compiled together: a shift table over blocks of two words tells how far a search may jump, a block that can
end a pattern selects the patterns of its suffix-and-prefix bucket, and their bytes are compared with the text's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import aliased, written
from .text import ALPHANUMERIC, LOWER, bounds, fingerprints, pair, raw, released, slices, words

LANE = 64  # search positions of one lane; lanes of a slice advance together


def _windows(item: bytes, size: int) -> list[bytes]:
    low = LOWER[np.frombuffer(item, np.uint8)]
    starts, ends, _ = words(low, np.array([0, low.size]), ALPHANUMERIC)
    own = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return [b" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))] if own else []


def window_rows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(pattern binary, item string): the windows of every item. Null items, null texts and texts without words have none."""

    def rows(batches):
        for batch in batches:
            out = [
                (w, item) for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True)
                if item is not None and text for w in set(_windows(text.encode(), size))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], ["pattern", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(rows, "pattern binary, item string")


class _Patterns:
    """Patterns of m words each."""

    def __init__(self, m: int, patterns: dict[bytes, list[str]]):
        self.m, self.block = m, min(2, m)
        self.texts, self.items = list(patterns), list(patterns.values())
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])])
        starts, ends, _ = words(data, offsets, ALPHANUMERIC)
        grid = fingerprints(data, starts, ends).reshape(len(self.texts), m)
        blocks = grid if self.block == 1 else pair(grid[:, :-1], grid[:, 1:])
        shift = np.broadcast_to(np.arange(blocks.shape[1])[::-1], blocks.shape)
        order = np.lexsort((shift.ravel(), blocks.ravel()))
        self.blocks, first = np.unique(blocks.ravel()[order], return_index=True)
        self.shifts = shift.ravel()[order][first]
        bucket = pair(blocks[:, -1], blocks[:, 0])
        self.order = np.argsort(bucket, kind="stable")
        self.buckets = bucket[self.order]

    def find(self, low, starts, ends, prints, begins) -> tuple[np.ndarray, np.ndarray]:
        """Word number of the last word, and pattern number, of each occurrence. begins: the first word of each text, and the end."""
        m, none = self.m, np.zeros(0, np.int64)
        begin, end = begins[:-1] + m - 1, begins[1:]  # a search position is a window's last word
        lanes = np.maximum(0, -(-(end - begin) // LANE))
        if not lanes.sum():
            return none, none
        within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(begin, lanes) + within * LANE
        stop = np.minimum(at + LANE, np.repeat(end, lanes))
        blocks = prints if self.block == 1 else np.concatenate([prints[:1], pair(prints[:-1], prints[1:])])
        found = []
        while at.size:
            here = blocks[at]
            k = np.minimum(np.searchsorted(self.blocks, here), self.blocks.size - 1)
            jump = np.where(self.blocks[k] == here, self.shifts[k], m - self.block + 1)
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        found = np.concatenate(found)
        bucket = pair(blocks[found], blocks[found - m + self.block])
        left, right = np.searchsorted(self.buckets, bucket), np.searchsorted(self.buckets, bucket, "right")
        many = right - left
        last = np.repeat(found, many)
        which = self.order[np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        same = np.fromiter((
            b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(e - m + 1, e + 1)) == self.texts[p]
            for e, p in zip(last, which, strict=True)), bool, last.size)
        return last[same], which[same]


def compiled(rows: list[tuple[bytes, str]]) -> list[_Patterns]:
    by: dict[int, dict[bytes, list[str]]] = {}
    for pattern, item in rows:
        by.setdefault(pattern.count(b" ") + 1, {}).setdefault(bytes(pattern), []).append(item)
    return [_Patterns(m, by[m]) for m in sorted(by)]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, per_pass: int = 200_000) -> DataFrame:
    """Every row of docs (its columns kept) with n_words, n_hit, n_items, items_sha256 and contaminated appended.

    A word is hit inside any occurrence of a pattern; occurrences overlap freely. Null or empty texts have no words and
    are not contaminated; repeated rows and repeated items each count once a row; an empty benchmark hits nothing.
    Columns of docs named like an output are replaced, others stay; items with a null item_id are passed over. At most
    `per_pass` patterns are broadcast at once: a larger benchmark is searched in several passes, each with its own part of
    the patterns, and every pass but the last ends in a written table.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs, names = aliased(docs.drop(*added), "text")
    patterns = window_rows(benchmark, size)
    passes = max(1, -(-patterns.count() // per_pass))
    spark = docs.sparkSession
    out = docs.withColumns({"_spans": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})
    schema = out.schema
    for i in range(passes):
        part = patterns.where(F.pmod(F.crc32("pattern"), F.lit(passes)) == i)
        table = spark.sparkContext.broadcast(compiled([tuple(r) for r in part.collect()]))
        if i < passes - 1:
            out = written(out.mapInArrow(released(_search(table)), schema), "searched")
            table.destroy()
    done = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"),
        "items_sha256": F.lit(""), "contaminated": F.lit(False)})
    search, summary = _search(table), _summary(docs.columns)
    return out.mapInArrow(released(lambda batches: summary(search(batches))), done.schema).withColumnsRenamed(names)  # one worker a task


def _search(table):
    def search(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                low = LOWER[data]
                starts, ends, doc = words(low, offsets, ALPHANUMERIC)
                prints, begins = fingerprints(low, starts, ends), bounds(doc, part.num_rows)
                spans, items = part.column("_spans").to_pylist(), part.column("_items").to_pylist()
                for one in table.value:
                    last, which = one.find(low, starts, ends, prints, begins)
                    for e, p in zip(last.tolist(), which.tolist(), strict=True):
                        d = int(doc[e])
                        spans[d] += [e - one.m + 1 - int(begins[d]), e + 1 - int(begins[d])]
                        items[d] += one.items[p]
                at = part.schema.get_field_index
                part = part.set_column(at("_spans"), "_spans", pa.array(spans, part.schema.field("_spans").type))
                yield part.set_column(at("_items"), "_items", pa.array([sorted(set(x)) for x in items], part.schema.field("_items").type))

    return search


def _summary(columns):
    def summary(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                _, _, doc = words(LOWER[data], offsets, ALPHANUMERIC)
                n = np.diff(bounds(doc, part.num_rows))
                hit, items = np.zeros(part.num_rows, np.int64), part.column("_items").to_pylist()
                for d, spans in enumerate(part.column("_spans").to_pylist()):
                    if spans:
                        edge = np.zeros(int(n[d]) + 1, np.int64)
                        np.add.at(edge, spans[::2], 1)
                        np.add.at(edge, spans[1::2], -1)
                        hit[d] = int((np.cumsum(edge) > 0).sum())
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns]
                    + [pa.array(n.astype(np.int64)), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(hit > 0)],
                    [*columns, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return summary
