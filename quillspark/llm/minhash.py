"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set of word shingles gives a MinHash signature of `coordinates` minima. A pair is a candidate if it agrees
on at least `matches` coordinates. Coordinate-value pairs are put in one order, the rarest first, and a document is
posted under the first coordinates - matches + 1 of its own (the prefix): two documents with enough matches share one of
these, while values that many unlike documents share (of common passages) stay out of prefixes. Postings of one list are
not paired with each other. They are merged with two pivots of the list, collisions are counted over the whole
signatures, and links are confirmed on the full sets. Then lists whose members are all in one component by now are
skipped. The documents of the others are posted once more in the same way, with all their shingles in place of the
signature's coordinates, so that the thresholds of prefix and position are those of the similarity itself: texts that
share much but not enough are not paired. Again only lists of several components count. In a few turns each of them takes
the most central member of its largest component as pivot, whose shingles are the most frequent ones, and each document
outside that component meets the PIVOTS pivots that most of its lists name: of a large group of near copies few stay
outside, at a cost of PIVOTS pairs a document and turn. What is left in these lists is paired across components and
confirmed, so no link depends on the turns.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .groups import runs
from .store import written
from .text import LOWER, NOT_BLANK, bounds, fingerprints, mix, pair, raw, released, slices, unpacked, words

SIDE = 512  # members that one task compares with a pivot
TURNS, YIELD = 4, 0.05  # of central pivots for lists still open, while such a share of the pairs are links; what is left is joined exactly
PIVOTS, DRAW = 2, 4  # pivots that a document meets in a turn; after the first turn pivots are drawn from one member in so many
MISS = 1e-6  # the most pairs, as a share, that the match threshold may lose at the similarity asked for


def matches_for(percent: int, coordinates: int) -> int:
    """The highest match threshold that a pair of just that similarity fails with a probability of at most MISS."""
    p, failing = percent / 100, 0.0
    for matches in range(coordinates):
        failing += comb(coordinates, matches) * p**matches * (1 - p) ** (coordinates - matches)
        if failing > MISS:
            return max(1, matches)
    return coordinates


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, end to end, and the offset of each text."""
    data, offsets = raw(column)
    low, n = LOWER[data], len(column)
    starts, ends, doc = words(low, offsets, NOT_BLANK)
    h = fingerprints(low, starts, ends)
    whole, of = h[: max(0, h.size - size + 1)], doc[: max(0, h.size - size + 1)]
    for k in range(1, size):
        whole = pair(whole, h[k : k + whole.size])
    inside = of == doc[size - 1 :] if whole.size else np.zeros(0, bool)
    begins = bounds(doc, n)
    few = np.flatnonzero((np.diff(begins) > 0) & (np.diff(begins) < size))
    short = h[begins[few]]
    count = np.diff(begins)[few]
    for k in range(1, size - 1):
        more = count > k
        short[more] = pair(short[more], h[begins[few[more]] + k])
    value = np.concatenate([whole[inside], mix(short + count.astype(np.uint64))])
    of = np.concatenate([of[inside], few])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], bounds(of[new], n)


def minima(value: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts, coordinates): the least product of a text's shingles with each coordinate's odd factor; 0 for texts without shingles."""
    factors = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
    out, full = np.zeros((at.size - 1, coordinates), np.uint64), np.flatnonzero(np.diff(at))
    for k in range(coordinates if full.size else 0):
        out[full, k] = np.minimum.reduceat(value * factors[k], at[full])
    return out


def _lists(signatures: np.ndarray) -> pa.ListArray:
    n, coordinates = signatures.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * coordinates), pa.array(signatures.ravel().astype(np.int64)))


def signed(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """(doc_id, mark, n_shingles, key, key2, signature, packed): a hash of the text, the set's size, fingerprint and minima, and the text's bytes compressed."""
    one, two = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)

    def sign(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                value, at = shingles(part.column("text"), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                key, key2 = np.zeros(n.size, np.uint64), np.zeros(n.size, np.uint64)
                if full.size:
                    key[full] = np.add.reduceat(mix(value ^ one), at[full])
                    key2[full] = np.add.reduceat(mix(value ^ two), at[full])
                texts = [packer.compress(t.encode("utf-8", "surrogatepass")) if c else None
                         for t, c in zip(part.column("text").to_pylist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(n.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(key2.astype(np.int64)), _lists(minima(value, at, coordinates)), pa.array(texts, pa.binary())],
                    ["doc_id", "mark", "n_shingles", "key", "key2", "signature", "packed"])

    return docs.selectExpr("cast(doc_id AS bigint) doc_id", "xxhash64(text) mark", "text").mapInArrow(
        released(sign), "doc_id long, mark long, n_shingles long, key long, key2 long, signature array<long>, packed binary")


def _prefixes(kinds: DataFrame, matches: int) -> DataFrame:
    """(id, place, value): the postings of the rarest coordinate values of each kind (id, signature), as many as the threshold asks for.

    A value that no other kind has counts as the rarest and takes its place, but is not posted.
    """
    values = kinds.select("id", F.posexplode("signature").alias("place", "value"))
    lists = values.groupBy("place", "value").agg(F.count(F.lit(1)).alias("long")).where("long > 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("long", "place"))
    among = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return (values.join(lists, ["place", "value"]).withColumns({"rank": rank, "shared": among})
            .where(F.col("rank") <= F.col("shared") - matches + 1).select("id", "place", "value"))


def _open(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """The postings of lists that still hold several components, with their own component c and the largest one's name."""
    lists = [c for c in posted.columns if c in ("place", "value")]
    of = posted.join(groups, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component")
    sizes = of.groupBy(*lists, "c").agg(F.count(F.lit(1)).alias("members"))
    several = sizes.groupBy(*lists).agg(F.count(F.lit(1)).alias("k"), F.max_by("c", F.struct("members", "c")).alias("largest")).where("k > 1").drop("k")
    return of.join(several, lists)


def _guesses(posted: DataFrame, groups: DataFrame, pairs: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of different components, not among `pairs`: each member of an open list outside its largest component with
    PIVOTS of the pivots of its lists, those that most of them name. A list's pivots are the member of the greatest weight in
    that component and the one outside it, after the first turn rather among members drawn by chance."""
    found = written(_open(posted, groups), "open", "snappy")
    outer = F.col("c") != F.col("largest")
    drawn = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(DRAW if turn else 1)) == 0
    first = F.struct(drawn.alias("drawn"), "weight", "id")
    named = found.groupBy("value").agg(
        F.max_by(F.struct("id", "n", "c"), F.when(~outer, first)).alias("one"), F.max_by(F.struct("id", "n", "c"), F.when(outer, first)).alias("own"))
    pivots = F.array("one", F.when(F.col("c") != F.col("own.c"), F.col("own")))
    met = found.where(outer).join(named, "value").select("id", "n", F.explode(pivots).alias("pivot"))
    met = met.where(F.least("n", "pivot.n") * 100 >= F.greatest("n", "pivot.n") * percent).groupBy("id", F.col("pivot.id").alias("pivot")).agg(F.count(F.lit(1)).alias("lists"))
    fresh = met.select("id", "lists", F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).join(pairs, ["a", "b"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("lists"), "a", "b"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select("a", "b").distinct()


def _shingled(ids: DataFrame, table: DataFrame, kinds: DataFrame, size: int) -> DataFrame:
    """(id, n, value): every shingle of the ids."""
    def all_of(batches):
        for batch in batches:
            for first, end, texts in unpacked(batch.column("packed")):
                part = batch.slice(first, end - first)
                value, at = shingles(pa.array(texts, pa.large_string()), size)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("id").to_numpy(), n)), pa.array(np.repeat(n, n).astype(np.int64)), pa.array(value.astype(np.int64))], ["id", "n", "value"])

    return _texts(ids, table, kinds).mapInArrow(released(all_of), "id long, n long, value long")


def _overlap(sizes, percent: int):
    """What two sets must share whose sizes have this sum."""
    return F.ceil(sizes * percent / (100 + percent) - 1e-9)


def _postings(ids: DataFrame, table: DataFrame, kinds: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, value, rank, weight): the shingles of each id among its first n - ceil(percent * n / 100) + 1, the rarest first.

    Shingles that no other id has come first and are not posted. weight is how often the id's shingles occur, on average:
    of near copies of one text, the one with the fewest changes has the greatest.
    """
    shingle = written(_shingled(ids, table, kinds, size), "shingles", "snappy")
    often = shingle.groupBy("value").agg(F.count(F.lit(1)).alias("long")).where("long > 1")
    own = Window.partitionBy("id")
    rank = F.row_number().over(own.orderBy("long", "value")) + F.col("n") - F.count(F.lit(1)).over(own)
    return written(
        shingle.join(often, "value").withColumns({"rank": rank, "weight": F.sum("long").over(own) / F.col("n")})
        .where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).select("id", "n", "value", "rank", "weight"), "postings", "snappy")


def _across(posted: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of posted ids in different components that may be similar enough: no such pair is missing.

    Of two similar sets the smaller has a common shingle among its first n - overlap + 1, the rarest first, where overlap
    is what sets of that size must share; the larger has it among its first n - ceil(percent * n / 100) + 1. What
    comes behind the two places bounds what the sets can share.
    """
    found = written(_open(posted.drop("weight"), groups), "open", "snappy")
    left = found.where(F.col("rank") <= F.col("n") - _overlap(F.col("n") * 2, percent) + 1)
    right = found.select("value", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("rank").alias("rank2"), F.col("c").alias("c2"))
    near = ((F.col("c") != F.col("c2")) & (F.col("n") <= F.col("n2")) & (F.col("n") * 100 >= F.col("n2") * percent)
            & (F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2")) + 1 >= _overlap(F.col("n") + F.col("n2"), percent)))
    one = left.where("c <> largest").join(right, "value").where(near)
    two = left.where("c = largest").join(right, "value").where(near & (F.col("c2") != F.col("largest")))
    return one.union(two).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _texts(ids: DataFrame, table: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, packed): the compressed text of each id."""
    own = kinds.join(ids, "id", "left_semi").select("id", F.col("name").alias("doc_id"), "key", "key2")
    return (table.where("packed IS NOT NULL").select("doc_id", "key", "key2", "packed")
            .join(own, ["doc_id", "key", "key2"]).select("id", "packed").dropDuplicates(["id"]))


def _agreeing(pairs: DataFrame, kinds: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) of kinds that agree on enough coordinates and whose sizes allow the similarity."""
    left = kinds.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    right = kinds.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    same = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda x: x))
    return (pairs.join(left, "a").join(right, "b")
            .where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (same >= matches)).select("a", "b"))


def _confirmed(pairs: DataFrame, table: DataFrame, kinds: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets. Each b comes to its a, at most SIDE or so to a task."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), table, kinds)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("long").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    heads = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("id"))
    wanted = heads.unionByName(dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id")))
    full = wanted.join(texts, "id").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def confirm(batches):
        head, held = None, None
        for group in runs(batches, ["a", "part", "role"]):
            for batch in group.to_batches():
                for first, end, texts in unpacked(batch.column("packed")):
                    part = batch.slice(first, end - first)
                    value, at = shingles(pa.array(texts, pa.large_string()), size)
                    if part.column("role")[0].as_py() == 0:
                        head, held = (part.column("a")[0].as_py(), part.column("part")[0].as_py()), value[at[0] : at[1]]
                        continue
                    assert head == (part.column("a")[0].as_py(), part.column("part")[0].as_py())
                    found = np.minimum(np.searchsorted(held, value), held.size - 1)
                    hits = np.concatenate([[0], np.cumsum(held[found] == value)])
                    shared, n = hits[at[1:]] - hits[at[:-1]], np.diff(at)
                    links = 100 * shared >= percent * (n + held.size - shared)
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("id")], ["a", "b"]).filter(pa.array(links))

    return full.mapInArrow(released(confirm), "a long, b long").distinct()


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 32) -> DataFrame:
    """(doc_id, mark, n_shingles, group, component_id) of every row of docs (doc_id, text).

    Words are runs of anything but blanks, A-Z lower-cased. A text of fewer than `size` words, but not none, has the
    whole sequence as its one shingle. Null, empty and blank texts have no shingle and link with nothing. Documents
    link when 100 * intersection >= percent * union; equal sets are linked without being paired. component_id is the
    smallest doc_id reachable. Rows of one doc_id with different texts are linked by their own texts only; rows with a
    null doc_id stay alone. An empty table gives no rows. mark is a hash of the text. group is a number of the rows linked,
    null for rows that link with nothing; it may differ between runs. The match
    threshold follows from `percent`: a pair of just that similarity fails it once in a million.
    """
    matches = matches_for(percent, coordinates)
    table = written(signed(docs, size, coordinates), "signed", "snappy")
    kinds = written(table.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key", "key2").agg(
        F.min("doc_id").alias("name"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
        .withColumn("id", F.monotonically_increasing_id()), "kinds", "snappy")
    prefix = written(_prefixes(kinds, matches), "prefix", "snappy")
    ends = prefix.groupBy("place", "value").agg(F.count(F.lit(1)).alias("long"), F.min("id").alias("first"), F.max("id").alias("last")).where("long > 1").drop("long")
    posted = written(prefix.join(ends, ["place", "value"]), "posted", "snappy")

    pivots = posted.select(F.col("id").alias("b"), F.explode(F.array("first", "last")).alias("a")).where("a <> b").distinct()
    pairs = written(_agreeing(pivots.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct(), kinds, matches, percent), "pairs", "snappy")
    links = lambda some: written(_confirmed(some, table, kinds, size, percent), "links", "snappy")  # noqa: E731  they are read twice
    groups = components(links(pairs))

    joined = lambda more: components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    ids = written(_open(posted.select("place", "value", "id"), groups).select("id").distinct(), "open", "snappy")
    places = _postings(ids, table, kinds, size, percent)
    for turn in range(TURNS):
        fresh = written(_guesses(places, groups, pairs, percent, turn), "pairs", "snappy")
        more = links(fresh)
        pairs, tried, found = pairs.union(fresh), fresh.count(), more.count()
        if found:
            groups = joined(more)
        if found <= YIELD * tried:
            break

    rest = written(_across(places, groups, percent).join(pairs, ["a", "b"], "left_anti"), "pairs", "snappy")
    if not rest.isEmpty():
        groups = joined(links(rest))

    named = kinds.join(groups, F.col("id") == F.col("node"), "left").select("key", "key2", "name", F.coalesce("component", "id").alias("group"))
    named = named.join(named.groupBy("group").agg(F.min("name").alias("component_id")), "group").drop("name")
    out = table.select("doc_id", "mark", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(k)).alias(k) for k in ("key", "key2")))
    known = F.col("doc_id").isNotNull()
    return out.join(named, ["key", "key2"], "left").select(
        "doc_id", "mark", "n_shingles", F.when(known, F.col("group")).alias("group"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs, see grouped(); rows with a null doc_id are kept."""
    return (grouped(docs, size, percent, coordinates).select("doc_id", "n_shingles", "component_id")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def survivors(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 32) -> DataFrame:
    """(doc_id, mark), each once: of every group the row of the smallest doc_id (of several texts of that id, the one of the
    smallest hash), and every row without shingles. Rows with a null doc_id are not among them."""
    rows = grouped(docs, size, percent, coordinates).where("doc_id IS NOT NULL")
    of_groups = rows.where("group IS NOT NULL AND doc_id = component_id").groupBy("group", "doc_id").agg(F.min("mark").alias("mark"))
    return of_groups.select("doc_id", "mark").unionByName(rows.where("group IS NULL").select("doc_id", "mark").distinct())
