"""Source divergence audit: which sources of a language use its terms in other shares than the language or each other.

A task takes its Arrow text buffers slice by slice. Each word start is a pointer into the buffer; multikey quicksort
orders the pointers by the words they point at, eight bytes a key. Equal runs then give the documents and occurrences of
each term for each source. Spark sums these over the slices, keeps the terms of enough documents, and compares the
sources in tiles: a block of sources against a block of sources over a part of the terms, with partial sums of the
differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, written
from .text import LOWER, raw, slices, words

#: Letters of ASCII in lower case, and every byte of a longer character: [^\x00-\x40\x5B-\x60\x7B-\x7F].
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

SLICE = 4 << 20  # bytes of text that are sorted at once
LEAF = 4096  # pointers that are sorted by their keys at once
BLOCK = 128  # sources in a side of a tile
PARTS = 64  # term parts of a tile, at least
PART_ROWS = 100_000  # rows of a term part, about

SCALE, ADDED = 1_000_000_000, 5

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def pointer_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the pointers in the order of their words, and which of them begin a run of equal words.

    Multikey quicksort: at a depth, the next eight bytes of each word are its key; a pivot parts smaller, equal and larger
    keys, and pointers with equal keys whose words go on are sorted eight bytes deeper. Words hold no zero byte, so the
    zeros behind a word's end tell words apart. Leaves of few pointers are sorted by key, all their ties at once.
    """
    padded = np.zeros(data.size + 16, np.uint8)
    padded[: data.size] = data
    eight = np.ndarray((data.size + 8,), "<u8", buffer=padded, strides=(1,))
    length = ends - starts

    def keys(who: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(length[who] - depth, 0, 8)
        return (eight[np.minimum(starts[who] + depth, data.size)] & _MASK[left]).byteswap()

    order, first = np.empty(starts.size, np.int64), np.zeros(starts.size, bool)
    stack = [(0, np.arange(starts.size), 0)]  # place of the part, its pointers, depth
    while stack:
        at, who, depth = stack.pop()
        key = keys(who, depth)
        if who.size > LEAF:
            sample = np.sort(key[:: max(1, who.size // 9)])
            pivot = sample[sample.size // 2]
            low, same = key < pivot, key == pivot
            small, equal, large = who[low], who[same], who[~(low | same)]
            stack.append((at, small, depth))
            stack.append((at + small.size + equal.size, large, depth))
            if int(pivot) & 0xFF:  # the last of the eight bytes is there: the words may go on
                stack.append((at + small.size, equal, depth + 8))
            elif equal.size:
                order[at + small.size : at + small.size + equal.size] = equal
                first[at + small.size] = True
            continue
        if not who.size:
            continue
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        new = np.ones(who.size, bool)
        new[1:] = key[1:] != key[:-1]
        tied = np.flatnonzero(_in_runs(new) & (key & np.uint64(0xFF) != 0))
        while tied.size:  # all open ties of the leaf, eight bytes deeper
            depth += 8
            run, key = np.cumsum(new)[tied], keys(who[tied], depth)
            by = np.lexsort((key, run))
            who[tied] = who[tied[by]]
            run, key = run[by], key[by]
            split = np.zeros(tied.size, bool)
            split[1:] = (key[1:] != key[:-1]) & (run[1:] == run[:-1])
            new[tied[split]] = True
            tied = tied[_in_runs(new)[tied] & (key & np.uint64(0xFF) != 0)]
        order[at : at + who.size], first[at : at + who.size] = who, new
    return order, first


def _in_runs(new: np.ndarray) -> np.ndarray:
    """Which members belong to runs of at least two."""
    single = new.copy()
    single[:-1] &= new[1:]
    return ~single


def _terms(batches):
    """(lang, source, term, n, docs) of each slice, from columns lang, source and text."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            data, offsets = raw(part.column("text"))
            data = LOWER[data]
            start, end, doc = words(data, offsets, LETTERS)
            if not start.size:
                continue
            names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
            codes = [n.indices.to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
            group = codes[0] * (len(names[1].dictionary) + 1) + codes[1]
            by = np.argsort(group, kind="stable")
            rank = np.empty_like(by)
            rank[by] = np.arange(by.size)  # documents in the order of their sources
            order, first = pointer_sort(data, start, end)
            run = np.cumsum(first) - 1
            pair = np.sort(run * by.size + rank[doc[order]])
            head = np.flatnonzero(np.diff(pair, prepend=-1))  # a term in a document
            n = np.diff(head, append=pair.size)
            own, rank_of = pair[head] // by.size, pair[head] % by.size
            at = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(group[by][rank_of], prepend=-1) != 0))
            word = order[np.flatnonzero(first)][own[at]]
            size = end[word] - start[word]
            ends = np.concatenate([[0], np.cumsum(size)])
            letters = data[np.repeat(start[word] - ends[:-1], size) + np.arange(ends[-1])]
            terms = pa.Array.from_buffers(pa.large_string(), at.size, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]).cast(pa.string())
            row = pa.array(by[rank_of[at]])
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(row), part.column("source").take(row), terms, pa.array(np.add.reduceat(n, at)), pa.array(np.diff(at, append=own.size))],
                ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in the texts of a source, and its documents that hold it."""
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    each = given.mapInArrow(_terms, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count, total):
    """1 + floor(SCALE * (count + ADDED) / total), in whole numbers."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {ADDED} AS DECIMAL(20,0))) DIV CAST({total} AS DECIMAL(28,0))").cast("long")


def _tiles(block: int):
    """(lang, a, b, more): for sources of a tile, the sum over its terms of |p - q| - |z - w| (z, w: shares of terms they lack).

    Rows come by tile (lang, left, right, part) and term; a row without a term names a source of the tile and its z.
    """

    def compare(batches):
        tile, sides, held = None, {}, []

        def flush(rows):
            """Adds whole terms to the sums of the open tile."""
            if not rows:
                return
            term = pa.concat_arrays([r[0] for r in rows]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            group, share = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
            column = np.cumsum(np.diff(term, prepend=term[0]) != 0)
            dense = []
            for ids, zero in sides["at"]:
                at = np.searchsorted(ids, group)
                own = (at < ids.size) & (ids[np.minimum(at, ids.size - 1)] == group)
                table = np.repeat(zero[:, None], column[-1] + 1, 1)
                table[at[own], column[own]] = share[own]
                dense.append(table)
            (_, z), (_, w) = sides["at"]
            width = column[-1] + 1
            for i in range(z.size):
                sides["sum"][i] += np.abs(dense[1] - dense[0][i]).sum(1) - width * np.abs(w - z[i])

        def close():
            flush(held)
            held.clear()
            if tile is None or "at" not in sides:
                return None
            (a, _), (b, _) = sides["at"]
            i, j = np.nonzero(a[:, None] < b[None, :])
            return pa.RecordBatch.from_arrays(
                [pa.array([tile[0]] * i.size, pa.string()), pa.array(a[i]), pa.array(b[j]), pa.array(sides["sum"][i, j])], ["lang", "a", "b", "more"])

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "part", "id", "p")}
            term, lang = batch.column("term"), batch.column("lang")
            codes = [lang.dictionary_encode().indices.to_numpy(zero_copy_only=False), cols["left"], cols["right"], cols["part"]]
            begins = np.flatnonzero(np.any([np.diff(c, prepend=c[:1] - 1) != 0 for c in codes], 0)).tolist()
            for lo, hi in zip(begins, [*begins[1:], batch.num_rows], strict=False):
                now = (lang[lo].as_py(), cols["left"][lo], cols["right"][lo], cols["part"][lo])
                if now != tile:
                    if (out := close()) is not None:
                        yield out
                    tile, sides = now, {"named": []}
                rows = slice(lo, hi)
                named = np.asarray(term.slice(lo, hi - lo).is_null())
                sides["named"] += list(zip(cols["id"][rows][named].tolist(), cols["p"][rows][named].tolist(), strict=True))
                if named.all():
                    continue
                if "at" not in sides:
                    named_ids = np.array(sorted(sides["named"]), np.int64).reshape(-1, 2)
                    both = [named_ids[named_ids[:, 0] // block == side] for side in (now[1], now[2])]
                    sides["at"] = [(x[:, 0], x[:, 1]) for x in both]
                    sides["sum"] = np.zeros([x.shape[0] for x in both], np.int64)
                held.append((term.slice(lo, hi - lo).filter(pa.array(~named)), cols["id"][rows][~named], cols["p"][rows][~named]))
                last = held[-1][0]
                if sum(len(h[0]) for h in held) > 50_000:  # all whole terms but the last, which may go on
                    keep = len(last) - 1
                    while keep > 0 and last[keep - 1] == last[-1]:
                        keep -= 1
                    done = [*held[:-1], (last.slice(0, keep), held[-1][1][:keep], held[-1][2][:keep])]
                    rest = (last.slice(keep), held[-1][1][keep:], held[-1][2][keep:])
                    if keep:
                        flush(done)
                        held[:] = [rest]
        if (out := close()) is not None:
            yield out

    return compare


def audit(docs: DataFrame, least: int = 30, best: int = 50, side: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) from docs(lang, source, text).

    Each language keeps the terms (runs of letters, A-Z lowered) of at least `least` of its documents: V terms. A group
    (lang, source), or a language, that holds `count` of them among N gives each kept term, also one it lacks, the share
    p = 1 + floor(1000000000 * (count + 5) / (N + 5 V)), in whole numbers. Part `pair` has a row for each other source of the
    language: the sum over the kept terms of |p - q|, ranked from the largest. Part `term` has the terms of the group with
    p above the language's q, the `best` largest p - q. Ties go by the item's bytes. A tile has up to `side` sources a side.

    Null text, lang and source are ''. Texts without letters give no terms, but their group is there; a language without
    kept terms has differences of 0. A language of one source has no pairs. Repeated rows are documents of their own.
    Other columns are not read; an empty table gives no rows.
    """
    counts = written(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    kept = written(kept.select("lang", "term", "all_n"), "kept")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = written(groups.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "groups")
    own = written(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "counts")
    discard(counts)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    sized = (groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "own_n"])
             .withColumn("zero", F.when(F.col("v") > 0, _share("0", f"own_n + {ADDED} * v"))))
    sized = written(sized.withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "sized")
    p, q = _share("n", f"own_n + {ADDED} * v"), _share("all_n", f"lang_n + {ADDED} * v")
    shared = written(own.join(sized, ["lang", "source"]).select("lang", "source", "id", "sources", "term", p.alias("p"), q.alias("q")), "shared")
    terms = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = _pairs(shared, sized, side)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by))
    return ranked(terms).where(F.col("rank") <= best).unionByName(ranked(pairs))


def _pairs(shared: DataFrame, sized: DataFrame, side: int) -> DataFrame:
    """(lang, source, part, item, value): the sum of the differences of each two sources of a language, both ways round."""
    parts = max(PARTS, shared.count() // PART_ROWS)
    block = (F.col("id") / side).cast("long")
    blocks = F.ceil(F.col("sources") / side).cast("long")
    # every tile that the source is in, as its left side or its right one
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.named_struct(F.lit("left"), F.least(block, other), F.lit("right"), F.greatest(block, other)))
    rows = shared.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).select("lang", "id", "term", "p", "part", F.inline(tiles))
    names = sized.where("v > 0").select(
        "lang", "id", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), tiles.alias("tiles"))
    names = names.select("lang", "id", "term", "p", "part", F.inline("tiles"))
    tile = ["lang", "left", "right", "part"]
    sums = rows.unionByName(names).repartition(*tile).sortWithinPartitions(*tile, F.asc_nulls_first("term")).select(*tile, "term", "id", "p").mapInArrow(
        _tiles(side), "lang string, a long, b long, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    named = lambda name: sized.select("lang", F.col("id").alias(name), F.col("source").alias(f"{name}_source"), F.col("zero").alias(f"{name}_zero"), "v")
    both = named("a").join(named("b").drop("v"), "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.when(F.col("v") > 0, F.coalesce("more", F.lit(0)) + F.col("v") * F.abs(F.col("a_zero") - F.col("b_zero"))).otherwise(0).cast("long")
    both = both.select("lang", value.alias("value"), F.inline(F.array(
        F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
