"""Removal of long repeated byte strings with a logarithmic family of levels of sampled suffixes.

Documents come in batches. A batch's level holds its sampled suffixes (see anchors.py) as keys and contexts with counts,
grouped by key; it keeps neither positions nor suffix order, so these are no suffix arrays in the strict sense. Equal-sized
levels are merged by grouping, so a suffix is rewritten once per doubling, and all levels are merged at the end of a call.
Strings are compared by fingerprints of 64 bits.
A run of strings whose whole context occurs twice is repeated; where only a part of two contexts agrees, one text of each
context is fetched and its strings of `length` bytes are sorted within their key, neighbours that are equal being repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import Prefixes, anchors
from .groups import whole_runs
from .store import aliased, discard, fresh, written
from .text import raw, released, slices, unpacked

GROUP = 5_000  # contexts of one key that a task compares; the strings of a larger key are dealt one by one

ROW = ["doc_id", "rid"]


class Family:
    """Levels of sampled suffixes whose sizes are powers of two batches: (key, context, n, kinds, hit), sorted within parts dealt by key.

    n counts a context, kinds the contexts of its key; hit says that the key's suffixes occur more than once.
    """

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}

    def add(self, suffixes: DataFrame) -> None:
        """Takes a batch of suffixes (key, context): its level is merged with the levels of its size, one after the other.

        A larger level is merged when one of its size has grown, or by repeated().
        """
        run = written(_scanned(suffixes.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"))), "run")
        size = 1
        while size in self.levels:
            run = self._merged(run, self.levels.pop(size))
            size *= 2
        self.levels[size] = run

    def _merged(self, run: DataFrame, level: DataFrame) -> DataFrame:
        both = run.select("key", "context", "n").union(level.select("key", "context", "n")).repartition("key")
        out = written(_scanned(both.groupBy("key", "context").agg(F.sum("n").alias("n"))), "run")
        discard(run)
        discard(level)
        return out

    def repeated(self) -> DataFrame:
        """Merges what levels are left, and gives the contexts of keys that were hit."""
        while len(self.levels) > 1:
            small, large = sorted(self.levels)[:2]
            self.levels[small + large] = self._merged(self.levels.pop(small), self.levels.pop(large))
        return next(iter(self.levels.values())).where("hit").select("key", "context", "n", "kinds")


def _scanned(rows: DataFrame) -> DataFrame:
    """Rows (key, context, n) with what the rows of one key tell together."""
    by = Window.partitionBy("key")
    return rows.withColumns({"kinds": F.count(F.lit(1)).over(by), "hit": F.sum("n").over(by) > 1})


def suffix_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, rid, first, last, key, context) of every run of every text; positions are in bytes of the text."""

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                text, first, last, _, key, context = anchors(data, offsets, length)
                rows = pa.array(text)
                begin = offsets[text]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("rid").take(rows), pa.array((first - begin).astype(np.int32)),
                     pa.array((last - begin).astype(np.int32)), pa.array(key), pa.array(context)],
                    [*ROW, "first", "last", "key", "context"])

    return docs.select(*ROW, "text").mapInArrow(released(find), _typed(docs, "first int, last int, key long, context long"))


def _typed(docs: DataFrame, more: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid long, {more}"


def _packed(docs: DataFrame, others: list[str]) -> DataFrame:
    """The rows with their text compressed, for a shuffle."""

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, "text", pa.array(texts, pa.binary()))

    return docs.select(*others, "text").mapInArrow(released(pack), docs.select(*others, F.col("text").cast("binary").alias("text")).schema)


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """By doc_id, null included, and rid."""
    other = right.withColumnsRenamed({"doc_id": "_doc", "rid": "_rid"})
    return left.join(other, left["doc_id"].eqNullSafe(other["_doc"]) & (left["rid"] == other["_rid"]), how).drop("_doc", "_rid")


def _contexts(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(doc_id, rid, first, width, whole, kinds, key, bytes): the bytes that the asked runs cover."""

    def fetch(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("rid", pa.int64()), ("first", pa.int32()), ("width", pa.int32()),
                              ("whole", pa.bool_()), ("kinds", pa.int64()), ("key", pa.int64()), ("bytes", pa.binary())])
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                text = unpack.decompress(row["text"])
                own = row["asked"]
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": row["doc_id"], "rid": row["rid"], "first": a["first"], "width": a["last"] - a["first"] + 1, "whole": a["whole"],
                      "kinds": a["kinds"], "key": a["key"], "bytes": text[a["first"] : a["last"] + length]} for a in own], schema=kept)

    schema = _typed(texts, "first int, width int, whole boolean, kinds long, key long, bytes binary")
    per_text = asked.groupBy(*ROW).agg(F.collect_list(F.struct("first", "last", "whole", "kinds", "key")).alias("asked"))
    return _joined(texts.select(*ROW, "text"), per_text, "inner").mapInArrow(released(fetch), schema)


def _strings(table: pa.Table, length: int):
    """Row number, place in the row's context and fingerprint of every string of `length` bytes."""
    column = table.column("bytes").combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    width = table.column("width").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(width.size), width)
    place = np.arange(row.size) - np.repeat(np.cumsum(width) - width, width)
    at = (ends[:-1] - ends[0])[row] + place
    return row, place, Prefixes(data).of(at, at + length)


def _partly(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, rid, start, stop): the bytes of strings that are repeated although their context as a whole is not."""

    def spans(table, row, place, repeated):
        """Runs of neighbouring repeated strings as byte ranges."""
        hit = np.flatnonzero(repeated & ~table.column("whole").to_numpy()[row])
        new = np.ones(hit.size, bool)
        new[1:] = (row[hit[1:]] != row[hit[:-1]]) | (place[hit[1:]] != place[hit[:-1]] + 1)
        begin = hit[new]
        end = hit[np.append(np.flatnonzero(new)[1:], hit.size) - 1] if hit.size else hit
        rows = pa.array(row[begin])
        first = table.column("first").to_numpy()[row[begin]]
        return pa.Table.from_arrays(
            [table.column("doc_id").take(rows), table.column("rid").take(rows), pa.array((first + place[begin]).astype(np.int32)),
             pa.array((first + place[end] + length).astype(np.int32))], [*ROW, "start", "stop"]).to_batches()

    def compare(batches):
        for table in whole_runs(batches, "key"):
            row, place, print_ = _strings(table, length)
            key = table.column("key").to_numpy()[row]
            order = np.lexsort((print_, key))
            same = (print_[order[1:]] == print_[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
            repeated = np.zeros(row.size, bool)
            repeated[order[1:][same]] = repeated[order[:-1][same]] = True
            yield from spans(table, row, place, repeated)

    def dealt(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            row, place, print_ = _strings(table, length)
            rows = pa.array(row)
            start = pa.array((table.column("first").to_numpy()[row] + place).astype(np.int32))
            yield from pa.Table.from_arrays(
                [*(table.column(c).take(rows) for c in (*ROW, "key", "whole")), start, pa.array(print_.astype(np.int64))], [*ROW, "key", "whole", "start", "print"]).to_batches()

    typed = _typed(contexts, "start int, stop int")
    few = contexts.where(F.col("kinds") <= GROUP).repartition("key").sortWithinPartitions("key").mapInArrow(released(compare), typed)
    each = contexts.where(F.col("kinds") > GROUP).mapInArrow(released(dealt), _typed(contexts, "key long, whole boolean, start int, print long"))
    twice = each.groupBy("key", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    many = each.where("NOT whole").join(twice, ["key", "print"]).select(*ROW, "start", (F.col("start") + length).cast("int").alias("stop"))
    return few.unionByName(many)


def repeated_spans(docs: DataFrame, length: int = 200, batches: int = 4) -> DataFrame:
    """(doc_id, rid, spans array<struct<start, stop>>): for texts with repeated strings, byte ranges that cover them (they may overlap)."""
    spark = docs.sparkSession
    at = fresh(spark, "suffixes")
    rows = suffix_rows(docs, length)
    rows.withColumn("batch", F.pmod(F.col("rid"), F.lit(batches)).cast("int")).write.option("compression", "zstd").partitionBy("batch").parquet(at)
    table = spark.read.schema(f"{_typed(docs, 'first int, last int, key long, context long')}, batch int").parquet(at)
    table.folder = at
    family = Family()
    for i in range(batches):
        family.add(table.where(F.col("batch") == i).select("key", "context"))
    repeated = family.repeated()
    marks = written(table.drop("batch").join(repeated, ["key", "context"])
                    .select(*ROW, "first", "last", "key", "context", (F.col("n") > 1).alias("whole"), "kinds"), "marks")
    for level in family.levels.values():
        discard(level)
    discard(table)
    shared = marks.where("kinds > 1")
    one = (shared.where("whole").groupBy("key", "context").agg(F.min(F.struct(*ROW, "first", "last", "whole", "kinds")).alias("one"))
           .select("one.*", "key"))
    asked = shared.where("NOT whole").select(*ROW, "first", "last", "whole", "kinds", "key").unionByName(one)
    parts = written(_partly(written(_contexts(_packed(docs, ROW), asked, length), "contexts"), length), "parts")
    whole = marks.where("whole").select(*ROW, F.col("first").alias("start"), (F.col("last") + length).cast("int").alias("stop")).distinct()
    return whole.unionByName(parts).groupBy(*ROW).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = 200, batches: int = 4, text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256 appended, or, if `text`, with its text cut and n_removed appended.

    A byte goes if it is in a string of `length` bytes that starts anywhere else, in the same text or another; overlaps
    count, and strings are judged on the texts as they come. Repeated rows are copies of each other. Null texts are
    empty (and stay null if `text`); texts under `length` bytes stay whole. Cut texts keep whole characters: a character
    that would be cut through stays. Columns named like an output are replaced, all others stay; doc_id
    may be of any type that has an order. An empty table gives no rows.
    """
    added = ["n_removed"] if text else ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs, names = aliased(docs.drop(*added), "doc_id", "text")
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    full = _joined(_packed(keyed, [*others, "rid"]), repeated_spans(keyed, length, batches), "left").select(*others, "text", "spans")
    kinds = {"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.lit("")}
    out = docs.select(*docs.columns if text else others, *(kinds[a].alias(a) for a in added))

    order = out.columns

    def finish(batches):
        for batch in batches:
            for first, end, texts in unpacked(batch.column("text")):
                part = batch.slice(first, end - first)
                found = [_cut(None if t is None else t.encode("utf-8", "surrogatepass"), s.as_py(), text) for t, s in zip(texts, part.column("spans"), strict=True)]
                columns = {c: part.column(c) for c in others}
                if text:
                    columns["text"] = pa.array([f[4] for f in found], pa.string())
                for name, i in (("n_bytes", 0), ("n_removed", 1), ("n_spans", 2)):
                    columns[name] = pa.array([f[i] for f in found], pa.int64())
                columns["kept_sha256"] = pa.array([f[3] for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)

    return full.mapInArrow(released(finish), out.schema).withColumnsRenamed(names)


def _cut(data: bytes | None, spans: list[dict] | None, text: bool) -> tuple:
    """Size, bytes removed, maximal runs removed, digest of the rest or the rest as text."""
    if data is None or not spans:
        own = data or b""
        return len(own), 0, 0, None if text else hashlib.sha256(own).hexdigest(), None if data is None or not text else data.decode("utf-8", "surrogatepass")
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["stop"] for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    array = np.frombuffer(data, np.uint8)
    if text:  # a character stays unless all its bytes go
        head = np.flatnonzero((array & 0xC0) != 0x80)
        gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, array.size)))
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    rest = array[~gone].tobytes()
    return array.size, int(gone.sum()), runs, None if text else hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "surrogatepass") if text else None
