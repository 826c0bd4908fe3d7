"""Embedding near-duplicates by E8 lattice hashing.

Each table projects unit vectors to blocks of eight random orthonormal directions, scales them, and decodes each block to
its nearest point of the E8 lattice; the points of all blocks are the cell. A vector is posted in its own cell and in
the neighbouring cells that a block's next nearest lattice points lead to. Two vectors of one label meet where their
postings share a cell of a table; their cosine in double precision decides.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import runs
from .store import written
from .text import mix, pair


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight numbers: D8, or D8 moved by a half in every coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


MINIMAL = _minimal()
APART = 0.331  # how far apart a block of two vectors at the cosine asked for may be expected to lie


def _code(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.uint64)
    for column in (points * 2).astype(np.int64).T:
        out = pair(out, column.astype(np.uint64))
    return out


@lru_cache(maxsize=256)
def _projection(width: int, blocks: int, seed: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions of a table (orthonormal where the width allows it) and its random offset."""
    random, directions = np.random.default_rng([seed, table, width]), 8 * blocks
    if width >= directions:
        axes = np.linalg.qr(random.standard_normal((width, width)))[0][:, :directions]
    else:
        axes = random.standard_normal((width, directions)) / np.sqrt(width)
    return axes, random.uniform(0, 2, directions)


def scale_for(width: int, cosine: float, scale: float) -> float:
    """`scale`, or less for narrow vectors or a low cosine: a block of two vectors at the cosine lies about scale * sqrt(8 * (2 - 2 * cosine) / width) apart."""
    return min(scale, APART / np.sqrt(8 * max(2 - 2 * cosine, 1e-12) / width))


def cells(unit: np.ndarray, tables: int, blocks: int, scale: float, probes: int, seed: int) -> np.ndarray:
    """(vectors, tables, 1 + probes) cell numbers: the own cell, then the `probes` nearest neighbouring cells."""
    n, width = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        axes, offset = _projection(width, blocks, seed, t)
        x = unit @ axes * scale + offset
        own, cost, codes = [], [], []
        for b in range(blocks):
            y = x[:, 8 * b : 8 * b + 8]
            point = decode(y)
            own.append(_code(point))
            # distance to point + m less distance to point, for each minimal vector m
            extra = 2.0 - 2.0 * (y - point) @ MINIMAL.T
            near = np.argpartition(extra, probes, axis=1)[:, : probes + 1] if probes else np.zeros((n, 0), int)
            cost.append(np.take_along_axis(extra, near, 1))
            codes.append(np.stack([_code(point + MINIMAL[near[:, k]]) for k in range(near.shape[1])], 1) if near.shape[1] else np.zeros((n, 0), np.uint64))

        def joined(parts, t=t):
            code = np.full(n, t + 1, np.uint64)
            for p in parts:
                code = pair(code, p)
            return code

        out[:, t, 0] = joined(own)
        moved = np.concatenate([np.stack([joined([*own[:b], codes[b][:, k], *own[b + 1 :]]) for k in range(codes[b].shape[1])], 1) for b in range(blocks)], 1) if probes else np.zeros((n, 0), np.uint64)
        best = np.argsort(np.concatenate(cost, 1), axis=1, kind="stable")[:, :probes] if probes else np.zeros((n, 0), int)
        out[:, t, 1:] = np.take_along_axis(moved, best, 1)
    return mix(out)


def _units(column: pa.Array) -> np.ndarray:
    """Rows of the list column as double unit vectors (all of one width)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, tables: int = 6, blocks: int = 2, scale: float = 2.5, probes: int = 2, seed: int = 11, side: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their widths are equal, and their cosine is at least `cosine`.
    Null, empty and zero vectors and those with null or non-finite components link with nothing. Equal vectors of one label are
    compared once and counted as often as they occur. A cell of any size is compared whole, in blocks of `side` vectors
    on different tasks; `scale` is the most, see scale_for. A pair that meets in several cells counts in the smallest of its first table. Repeated rows
    of one vec_id count as rows of their own, and so do different vectors of one vec_id; rows with a null vec_id link like
    others and are kept; an empty table gives no rows.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    clean = vectors.select("vec_id", "label", "embedding")
    # a zero of either sign is one value
    fit = (F.col("label").isNotNull() & (F.size("embedding") > 0)
           & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    keyed = clean.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)))
    keyed = keyed.withColumn("same", F.when(F.col("fit"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")), 256)))
    kinds = written(keyed.where("fit").groupBy("same").agg(
        F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("id", F.monotonically_increasing_id()), "vectors")
    kinds = kinds.withColumn("kind", F.xxhash64(F.col("label").cast("string"), F.size("embedding")))

    def shape(width: int):
        return tables, blocks, scale_for(width, cosine, scale), probes, seed

    def post(batches):
        for batch in batches:
            for table in runs(_by_width(batch), ["width"]):
                rows = table.combine_chunks().to_batches()[0]
                unit = _units(rows.column("embedding"))
                code = cells(unit, *shape(unit.shape[1])).reshape(rows.num_rows, -1).astype(np.int64)
                per = code.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rows.column(c).to_numpy(), per)) for c in ("id", "kind")] + [pa.array(code.ravel())], ["id", "kind", "cell"])

    posted = kinds.select("id", "kind", "embedding").mapInArrow(post, "id long, kind long, cell long").distinct()
    sizes = posted.groupBy("kind", "cell").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / side).cast("int")).drop("count")
    # a cell of several parts is compared part by part: each vector goes to every pair of parts that holds its own
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = (posted.join(sizes, ["kind", "cell"]).select("id", "kind", "cell", own.alias("part"), other.alias("other"))
              .select("id", "kind", "cell", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")))
    full = spread.join(kinds.select("id", "n", "embedding"), "id").repartition("kind", "cell", "p", "q").sortWithinPartitions("kind", "cell", "p", "q")
    found = written(full.mapInArrow(_compared(cosine, shape, probes), "a long, links long, b long"), "found")
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    per_kind = (kinds.select("same", "id", "name", "n").join(counts, F.col("id") == F.col("a"), "left").join(linked, F.col("id") == F.col("node"), "left")
                .select("same", "name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("group")))
    per_kind = per_kind.join(per_kind.groupBy("group").agg(F.min("name").alias("component_id")), "group").drop("group", "name")
    out = keyed.select("vec_id", "same").join(per_kind, "same", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _by_width(batch: pa.RecordBatch):
    """The batch with its rows' widths, rows of one width together."""
    width = np.diff(batch.column("embedding").offsets.to_numpy())
    order = pa.array(np.argsort(width, kind="stable"))
    yield batch.append_column("width", pa.array(width.astype(np.int64))).take(order)


def _compared(cosine, shape, probes):
    def compare(batches):
        for group in runs(batches, ["kind", "cell", "p", "q"]):
            group = group.combine_chunks()
            ids, n, part = (group.column(c).to_numpy() for c in ("id", "n", "part"))
            if ids.size < 2:
                continue
            unit = _units(group.column("embedding").combine_chunks())
            p, q, cell = group.column("p")[0].as_py(), group.column("q")[0].as_py(), np.uint64(group.column("cell")[0].as_py() & (2**64 - 1))
            left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
            i, j = np.nonzero(unit[left] @ unit[right].T >= cosine)
            i, j = left[i], right[j]
            if p == q:
                i, j = i[i < j], j[i < j]
            if not i.size:
                continue
            near, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            codes = cells(unit[near], *shape(unit.shape[1]))
            ci, cj = codes[at[: i.size]], codes[at[i.size :]]
            first = np.full(i.size, True)
            table = _table_of(cell, codes)
            for t in range(table + 1):
                for a, b in product(range(1 + probes), repeat=2):
                    same = ci[:, t, a] == cj[:, t, b]
                    first &= ~(same if t < table else same & (ci[:, t, a] < cell))
            links = np.bincount(i[first], n[j[first]], ids.size) + np.bincount(j[first], n[i[first]], ids.size)
            root = _roots(i, j, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[near]), pa.array(links[near].astype(np.int64)), pa.array([r if r != s else None for r, s in zip(root[near].tolist(), ids[near].tolist(), strict=True)], pa.int64())],
                ["a", "links", "b"])

    return compare


def _table_of(cell: np.uint64, codes: np.ndarray) -> int:
    """The table that the cell belongs to: every vector of the group is posted in it."""
    return int(np.flatnonzero((codes[0] == cell).any(1))[0])


def _roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id reachable by the pairs (i, j)."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            return label
        label = new
