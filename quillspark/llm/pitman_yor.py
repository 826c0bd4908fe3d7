"""A hierarchical Pitman-Yor language model over words, fitted by Gibbs sampling of restaurant seatings.

The context of a token is the word before it (a text's start has the end token's): every word is a restaurant. Its parent
is the restaurant of the word's class: a coarse class by its last two bytes, cut into fine classes by its fingerprint. A
fine class's parent is its coarse class, all coarse ones share the unigram restaurant, and that one's base is uniform
over the words and one unknown. A word's dish is wholly in one bucket with its customers and tables in every restaurant.
Restaurants touch each other only through totals. Those of the classes are a fixed number and go through the driver;
those of the words grow with the texts: each bucket sends its tables of every context to the bucket of that word, which
adds them up and answers. So a sweep reseats all dishes of all buckets in parallel, given the totals of the sweep before.
Seating starts anew in each sweep: what a sweep takes from the one before are the totals and the parents' tables.
Probabilities are averaged over the kept sweeps; in each they sum to one over the words and the unknown.

Texts are dealt in chunks. A chunk asks a bucket once for each distinct pair of word and context, and the answers come back
to it in that order: what moves is distinct pairs, never tokens. Chunks are scored in a few rounds, so that the requests and
answers of one round are on disk at a time; each round opens the model again.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import runs
from .store import discard, written
from .text import LOWER, NOT_BLANK, fingerprints, mix, raw, slices, words

COARSE, FINE = 32, 8  # classes; the first coarse class is that of a text's start
CLASSES = COARSE * FINE
END = np.uint64(0x454E44454E44454E)
CHUNK_BYTES = 8 << 20  # of text, in a chunk and for each bucket
ROUNDS = 3  # in which texts are scored: requests and answers of one round stand on disk at a time
TEXT = 1 << 62  # comes after all buckets
BLOCK = 16  # customers of a large dish sit down in blocks of a sixteenth of those seated


def tokens(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprint, class as a context, and text number of each token; every text has one end token, which is also its start's context."""
    starts, ends, doc = words(low, offsets, NOT_BLANK)
    n = offsets.size - 1
    at = np.arange(starts.size) + doc  # the end tokens of earlier texts come before
    total = starts.size + n
    word, of = np.full(total, END), np.zeros(total, np.int64)
    prints = fingerprints(low, starts, ends)
    word[at] = np.where(prints == END, prints + np.uint64(1), prints)
    stop = np.ones(total, bool)
    stop[at] = False
    of[at], of[stop] = doc, np.arange(n)
    tail = low[ends - 1].astype(np.uint64) | (np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64) << np.uint64(8))
    own = np.zeros(total, np.int64)
    own[at] = (1 + mix(tail) % np.uint64(COARSE - 1)).astype(np.int64) * FINE + (prints >> np.uint64(61)).astype(np.int64)
    return word, own.astype(np.uint8), of.astype(np.int32)


class Chunk:
    """The distinct pairs (word, word before) of some texts, ordered by the word's bucket, the word, and the word before.

    names are the words in that order (each word before is one of them), cls their classes; word and before number them.
    """

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int):
        word = np.concatenate([p[0] for p in parts])
        names, first, at = np.unique(word, return_index=True, return_inverse=True)
        own = np.concatenate([p[1] for p in parts])[first]
        del word, first
        of = _bucket(names, buckets)
        order = np.argsort(of, kind="stable")
        place = np.empty(order.size, np.int32)
        place[order] = np.arange(order.size)
        self.names, self.cls, at = names[order], own[order], place[at]
        before = np.empty_like(at)
        before[1:], before[:1] = at[:-1], at[-1:]  # the last token is an end token, as each before a text
        code, pair, self.n = np.unique(at.astype(np.int64) * names.size + before, return_inverse=True, return_counts=True)
        self.word, self.before = np.divmod(code, names.size)
        self.token, self.pair = at, pair.astype(np.int32)  # name and pair of each token
        self.buckets, self.first = np.unique(of[order], return_index=True)

    def parts(self):
        """(bucket, number of its first name, names, pairs as a slice) of each bucket that has any."""
        last = np.append(self.first[1:], self.names.size)
        for b, i, j in zip(self.buckets.tolist(), self.first.tolist(), last.tolist(), strict=True):
            yield b, i, j, slice(*np.searchsorted(self.word, [i, j]).tolist())

    def blobs(self, counted: bool):
        for b, i, j, own in self.parts():
            context, at = np.unique(self.before[own], return_inverse=True)
            more = {"n": _small(self.n[own])} if counted else {}
            yield b, _dump(word=self.names[i:j], many=_small(np.bincount(self.word[own] - i, minlength=j - i)),
                           context=self.names[context], cls=self.cls[context], at=_small(at), **more)


def _small(x: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def _dump(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _load(blob: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word ^ np.uint64(5)) % np.uint64(buckets)).astype(np.int64)


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): the pairs of training texts with counts, summed over each task's chunks of text."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                held.append(tokens(LOWER[data], offsets))
                size += data.size
                if size >= CHUNK_BYTES:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def send(held):
        rows = list(Chunk(held, buckets).blobs(True))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    return docs.select("text").mapInArrow(count, "bucket long, blob binary")


@dataclass
class Totals:
    """What restaurants know of each other: customers and tables of every fine and coarse class and of the unigram one."""

    fine: np.ndarray  # (2, CLASSES)
    coarse: np.ndarray  # (2, COARSE)
    root: np.ndarray  # (2,)
    discounts: tuple[float, float, float, float]  # of the root, the coarse and fine classes and the words
    strengths: tuple[float, float, float, float]
    base: float

    @staticmethod
    def length() -> int:
        return 2 * CLASSES + 2 * COARSE + 2

    @classmethod
    def of(cls, flat: np.ndarray, **more) -> Totals:
        a, b = 2 * CLASSES, 2 * CLASSES + 2 * COARSE
        return cls(flat[:a].reshape(2, -1), flat[a:b].reshape(2, -1), flat[b : b + 2], **more)


class Dishes:
    """The dishes of one bucket. Pairs are (word number, context number) in order; fine and coarse pairs follow from them."""

    def __init__(self, words, context, cls, pair, n):
        self.words, self.context, self.context_cls, self.pair, self.pair_n = words, context, cls, pair, n
        of, self.at = np.divmod(pair, max(context.size, 1))
        fine, self.down = np.unique(of * CLASSES + cls[self.at], return_inverse=True)
        self.of, self.cls = np.divmod(fine, CLASSES)
        coarse = self.of * COARSE + self.cls // FINE
        self.coarse, self.up = np.unique(coarse, return_inverse=True)
        self.counts = np.bincount(of, n, self.words.size).astype(np.int64)
        # one table a dish to begin with
        self.pair_t = np.ones(pair.size, np.int64)
        self.t = np.ones(fine.size, np.int64)
        self.t1 = np.ones(self.coarse.size, np.int64)
        self.t0 = np.ones(self.words.size, np.int64)
        self.seated()

    def seated(self) -> None:
        """Customers of the parents: the tables below."""
        self.n = np.bincount(self.down, self.pair_t, self.of.size).astype(np.int64)
        self.n1 = np.bincount(self.up, self.t, self.coarse.size).astype(np.int64)
        self.n0 = np.bincount(self.coarse // COARSE, self.t1, self.words.size).astype(np.int64)

    def of_contexts(self) -> np.ndarray:
        """The tables of each context that this bucket's dishes have."""
        return np.bincount(self.at, self.pair_t, self.context.size).astype(np.int64)

    def totals(self) -> np.ndarray:
        g = self.coarse % COARSE
        return np.concatenate([
            np.bincount(self.cls, self.n, CLASSES), np.bincount(self.cls, self.t, CLASSES),
            np.bincount(g, self.n1, COARSE), np.bincount(g, self.t1, COARSE), [self.n0.sum(), self.t0.sum()]]).astype(np.int64)

    def root(self, s: Totals) -> np.ndarray:
        d, a = s.discounts[0], s.strengths[0]
        return (self.n0 - d * self.t0 + (a + d * s.root[1]) * s.base) / (a + s.root[0])

    def middle(self, s: Totals) -> np.ndarray:
        d, a, g = s.discounts[1], s.strengths[1], self.coarse % COARSE
        return (self.n1 - d * self.t1 + (a + d * s.coarse[1][g]) * self.root(s)[self.coarse // COARSE]) / (a + s.coarse[0][g])

    def sweep(self, s: Totals, tables: np.ndarray, random: np.random.Generator) -> None:
        """Reseats every customer of every dish, restaurant by restaurant from the words to the root. tables: of each context, in all buckets."""
        d, a = s.discounts, s.strengths
        many = np.flatnonzero(self.pair_n > 1)
        opening = (a[3] + d[3] * tables[self.at[many]]) * _probabilities(self, s)[2][self.down[many]]
        self.pair_t[many] = _tables(self.pair_n[many], opening, d[3], random)
        self.seated()
        self.t = _tables(self.n, (a[2] + d[2] * s.fine[1][self.cls]) * self.middle(s)[self.up], d[2], random)
        self.seated()
        self.t1 = np.minimum(self.t1, self.n1)
        g = self.coarse % COARSE
        self.t1 = _tables(self.n1, (a[1] + d[1] * s.coarse[1][g]) * self.root(s)[self.coarse // COARSE], d[1], random)
        self.seated()
        self.t0 = _tables(self.n0, np.full(self.n0.size, (a[0] + d[0] * s.root[1]) * s.base), d[0], random)

    def state(self) -> dict:
        return {k: _small(getattr(self, k)) for k in ("pair_t", "t", "t1", "t0")}

    def restore(self, state: dict) -> Dishes:
        self.pair_t, self.t, self.t1, self.t0 = (state[k].astype(np.int64) for k in ("pair_t", "t", "t1", "t0"))
        self.seated()
        return self


def _tables(n: np.ndarray, opening: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables after n customers of each dish sat down one by one; a new table is opened with weight `opening`.

    Beyond 64 customers they come in blocks that see the tables as the block found them.
    """
    order = np.argsort(-n, kind="stable")
    n, opening = n[order], opening[order]
    t, seated = np.minimum(n, 1).astype(np.int64), 1
    while True:
        active = int(np.searchsorted(-n, -seated))  # dishes with more customers than are seated
        if not active:
            break
        new = opening[:active] / (opening[:active] + np.maximum(seated - discount * t[:active], 1e-12))
        if seated < 64:
            t[:active] += random.random(active) < new
            seated += 1
        else:
            step = seated // BLOCK
            t[:active] += random.binomial(np.minimum(step, n[:active] - seated), new)
            seated += step
    out = np.empty_like(t)
    out[order] = t
    return out


def _merged(parts: list[dict], buckets: int) -> Dishes:
    words = np.unique(np.concatenate([p["word"] for p in parts]))
    every = np.concatenate([p["context"] for p in parts])
    names, first, back = np.unique(every, return_index=True, return_inverse=True)
    order = np.argsort(_bucket(names, buckets), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(order.size)
    back = place[back]
    begins = np.cumsum([0, *(p["context"].size for p in parts)])
    code = np.concatenate([
        np.repeat(np.searchsorted(words, p["word"]), p["many"]) * names.size + back[i + p["at"].astype(np.int64)] for p, i in zip(parts, begins, strict=False)])
    pair, at = np.unique(code, return_inverse=True)
    n = np.bincount(at, np.concatenate([p["n"] for p in parts]), pair.size).astype(np.int64)
    return Dishes(words, names[order], np.concatenate([p["cls"] for p in parts])[first][order], pair, n)


def _dished(counted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, dishes, states, totals, seen): one row a bucket, with all its dishes and one table each."""

    def gather(batches):
        for group in runs(batches, ["bucket"]):
            own = _merged([_load(b) for b in group.column("blob").to_pylist()], buckets)
            seen = [own.words.size, int(own.counts.sum()), *((x == k).sum() for x in (own.n0, own.n1, own.n, own.pair_n) for k in (1, 2))]
            of, at = np.divmod(own.pair, own.context.size)
            dishes = _dump(word=own.words, many=_small(np.bincount(of, minlength=own.words.size)), context=own.context, cls=own.context_cls, at=_small(at), n=_small(own.pair_n))
            yield pa.RecordBatch.from_arrays(
                [group.column("bucket").combine_chunks().slice(0, 1), pa.array([dishes], pa.binary()), pa.array([_dump(sweeps=[own.state()])], pa.binary()),
                 pa.array([own.totals().tolist()], pa.list_(pa.int64())), pa.array([[int(x) for x in seen]], pa.list_(pa.int64()))], ["bucket", "dishes", "states", "totals", "seen"])

    return counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        gather, "bucket long, dishes binary, states binary, totals array<long>, seen array<long>")


def _opened(row: dict) -> Dishes:
    p = _load(row["dishes"])
    pair = np.repeat(np.arange(p["word"].size), p["many"]) * p["context"].size + p["at"]
    return Dishes(p["word"], p["context"], p["cls"], pair.astype(np.int64), p["n"].astype(np.int64))


def _contexts(model: DataFrame, buckets: int) -> DataFrame:
    """(bucket, of, blob): the tables of each context, in all buckets, in the last state of the model.

    For each bucket and each `of`, a bucket of contexts, the tables of the bucket's contexts there, in order; with `of` -1
    the words of the bucket as contexts, and their tables.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = _opened(row).restore(_load(row["states"])["sweeps"][-1])
                tables, of = own.of_contexts(), _bucket(own.context, buckets)
                to, first = np.unique(of, return_index=True)
                last = np.append(first[1:], of.size)
                blobs = [_dump(context=own.context[i:j], tables=_small(tables[i:j])) for i, j in zip(first, last, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array([row["bucket"]] * to.size, pa.int64()), pa.array(blobs, pa.binary())], ["of", "bucket", "blob"])

    def add(batches):
        for group in runs(batches, ["of"]):
            parts = [_load(b) for b in group.column("blob").to_pylist()]
            names, at = np.unique(np.concatenate([p["context"] for p in parts]), return_inverse=True)
            tables = np.bincount(at, np.concatenate([p["tables"] for p in parts]), names.size).astype(np.int64)
            cuts = np.cumsum([p["context"].size for p in parts])[:-1]
            of, to = group.column("of")[0].as_py(), group.column("bucket").to_pylist()
            blobs = [_dump(tables=_small(tables[i])) for i in np.split(at, cuts)] + [_dump(context=names, tables=_small(tables))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*to, of], pa.int64()), pa.array([of] * len(to) + [-1], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "of", "blob"])

    sent = model.select("bucket", "dishes", "states").mapInArrow(send, "of long, bucket long, blob binary")
    return sent.repartition(buckets, "of").sortWithinPartitions("of").mapInArrow(add, "bucket long, of long, blob binary")


def _swept(model: DataFrame, contexts: DataFrame, totals: Totals, sweep: int, keep: int, buckets: int) -> DataFrame:
    """The model with one more sweep; the states of the last `keep` sweeps are kept."""
    schema = model.schema
    both = model.withColumns({"of": F.lit(None).cast("long"), "blob": F.lit(None).cast("binary")}).unionByName(contexts.where("of >= 0"), allowMissingColumns=True)

    def resit(batches):
        for group in runs(batches, ["bucket"]):
            rows = group.to_pylist()
            model, tables = rows[-1], np.concatenate([_load(r["blob"])["tables"].astype(np.int64) for r in rows[:-1]])
            row = {f.name: model[f.name] for f in schema}
            states = _load(row["states"])["sweeps"]
            own = _opened(row).restore(states[-1])
            own.sweep(totals, tables, np.random.default_rng([sweep, row["bucket"]]))
            row |= {"states": _dump(sweeps=[*states, own.state()][-keep:]), "totals": own.totals().tolist()}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([group.schema.field(f.name) for f in schema]))

    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_last("of")).mapInArrow(resit, schema)


def _summed(model: DataFrame, column: str, length: int) -> np.ndarray:
    out = np.zeros(length, np.float64)
    for pos, total in model.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col")).collect():
        out[pos] = total
    return out


@dataclass
class Fitted:
    """model: (bucket, dishes, states, ...); contexts, samples: the tables of words as contexts, and the totals, of each kept sweep."""

    model: DataFrame
    contexts: list[DataFrame]
    samples: list[Totals]
    buckets: int
    words: int
    tokens: int


def fit(docs: DataFrame, sweeps: int = 4, keep: int = 2) -> Fitted:
    """Fits on the whole texts of docs (null: empty) by `sweeps` Gibbs sweeps, of which the last `keep` are averaged.

    Discounts come from the numbers of dishes with one and with two customers in each level; strengths are 1.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // CHUNK_BYTES))
    model = written(_dished(_counted(docs, buckets), buckets), "model", "uncompressed")
    seen = _summed(model, "seen", 10)
    discounts = tuple(min(0.95, max(0.05, (one + 1) / (one + 2 * two + 2))) for one, two in seen[2:].reshape(4, 2))
    fixed = {"discounts": discounts, "strengths": (1.0, 1.0, 1.0, 1.0), "base": 1 / (seen[0] + 1)}
    samples = [Totals.of(_summed(model, "totals", Totals.length()), **fixed)]
    contexts = [written(_contexts(model, buckets), "contexts", "uncompressed")]
    for i in range(sweeps):
        before, model = model, written(_swept(model, contexts[-1], samples[-1], i, keep, buckets), "model", "uncompressed")
        discard(before)
        samples.append(Totals.of(_summed(model, "totals", Totals.length()), **fixed))
        contexts.append(written(_contexts(model, buckets), "contexts", "uncompressed"))
        if len(contexts) > keep:
            discard(contexts.pop(0))
    return Fitted(model, contexts[-keep:], samples[-keep:], buckets, int(seen[0]), int(seen[1]))


def _asked(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, blob): the distinct pairs of each chunk."""

    def ask(batches):
        unpack = zstandard.ZstdDecompressor()
        for group in runs(batches, ["chunk"]):
            held = [tokens(LOWER[data], offsets) for batch in group.to_batches() for part in _unpacked(batch, unpack) for data, offsets in [raw(part.column("text"))]]
            rows = list(Chunk(held, buckets).blobs(False))
            del held
            chunk = group.column("chunk")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "chunk", "blob"])

    return texts.mapInArrow(ask, "bucket long, chunk long, blob binary")


def _unpacked(batch: pa.RecordBatch, unpack):
    texts = [None if t is None else unpack.decompress(t).decode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    yield from slices(batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.large_string())), "text")


def _answered(asked: DataFrame, fitted: Fitted) -> DataFrame:
    """(chunk, bucket, blob): the answers to each part of a chunk, in its order.

    For each word its training count, and its tables as a context in each sample; for each pair the customers and the tables of
    each sample; for each distinct pair of word and class the probability of each sample.
    """
    empty = {k: F.lit(None).cast("binary").alias(k) for k in ("dishes", "states", "blob")}
    samples, keep = fitted.samples, len(fitted.samples)
    both = fitted.model.select("bucket", F.lit(-keep - 1).cast("long").alias("chunk"), "dishes", "states", empty["blob"])
    for k, own in enumerate(fitted.contexts):
        both = both.unionByName(own.where("of = -1").select("bucket", F.lit(k - keep).cast("long").alias("chunk"), empty["dishes"], empty["states"], "blob"))
    both = both.unionByName(asked.select("bucket", "chunk", empty["dishes"], empty["states"], "blob"))

    def answer(batches):
        held, bucket, states, contexts = None, None, [], {}
        for row in (row for batch in batches for i in range(0, batch.num_rows, 16) for row in batch.slice(i, 16).to_pylist()):
            if bucket != row["bucket"]:
                held, bucket, states, contexts = None, row["bucket"], [], {}
            if row["chunk"] < -keep:
                own, states = _opened(row), _load(row["states"])["sweeps"]
                held = own, [_probabilities(own.restore(s), t) for s, t in zip(states, samples, strict=True)]
                continue
            p = _load(row["blob"])
            if row["chunk"] < 0:
                contexts[row["chunk"] + keep] = p
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]], pa.int64()), pa.array([bucket], pa.int64()), pa.array([_reply(held, states, contexts, samples, p)], pa.binary())], ["chunk", "bucket", "blob"])

    return both.repartition(fitted.buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(answer, "chunk long, bucket long, blob binary")


def _reply(held, states: list[dict], contexts: dict, samples: list[Totals], p: dict) -> bytes:
    of, at = np.repeat(np.arange(p["word"].size), p["many"]), p["at"].astype(np.int64)
    fine = np.unique(of * CLASSES + p["cls"][at])
    count, chances = _parents(held, samples, p["word"], np.bincount(fine // CLASSES, minlength=p["word"].size), fine % CLASSES)
    tables = np.zeros((len(samples), p["word"].size), np.int64)
    n, seated = np.zeros(of.size, np.int64), np.zeros((len(samples), of.size), np.int64)
    for k, own in contexts.items():
        tables[k] = np.where((j := _lookup(own["context"], p["word"], True)) >= 0, own["tables"][j], 0)
    if held:
        own = held[0]
        order = np.argsort(own.context)
        word, context = _lookup(own.words, p["word"], True)[of], _lookup(own.context[order], p["context"], True)
        context = np.where(context >= 0, order[context], -1)[at]
        found = _lookup(own.pair, word * own.context.size + context, (word >= 0) & (context >= 0))
        n = np.where(found >= 0, own.pair_n[found], 0)
        for k, state in enumerate(states):
            seated[k] = np.where(found >= 0, state["pair_t"][found], 0)
    return _dump(count=_small(count), tables=_small(tables), n=_small(n), seated=_small(seated), chance=np.stack(chances).astype(np.float32))


def _probabilities(own: Dishes, s: Totals):
    """Of each word at the root, of each coarse pair, of each fine pair."""
    d, a = s.discounts[2], s.strengths[2]
    root, middle = own.root(s), own.middle(s)
    fine = (own.n - d * own.t + (a + d * s.fine[1][own.cls]) * middle[own.up]) / (a + s.fine[0][own.cls])
    return root, middle, fine


def _replies(held, samples: list[Totals], word, many, cls):
    """Training count of each word, and log10 of the averaged probability of each pair of word and class."""
    count, chances = _parents(held, samples, word, many, cls)
    return count, np.log10(sum(chances) / len(samples))


def _parents(held, samples: list[Totals], word, many, cls):
    """Training count of each word, and the probability of each pair of word and class in each sample."""
    of = np.repeat(np.arange(word.size), many)
    chances, count = [], np.zeros(word.size, np.int64)
    if held:
        own = held[0]
        at = np.minimum(np.searchsorted(own.words, word), own.words.size - 1)
        known = own.words[at] == word
        count[known] = own.counts[at[known]]
        low = _lookup(own.of * CLASSES + own.cls, at[of] * CLASSES + cls, known[of])
        mid = _lookup(own.coarse, at[of] * COARSE + cls // FINE, known[of])
    for k, s in enumerate(samples):
        (d0, d1, d2), (a0, a1, a2) = s.discounts[:3], s.strengths[:3]
        p = np.full(of.size, (a0 + d0 * s.root[1]) * s.base / (a0 + s.root[0]))
        if held:
            root, middle, fine = held[1][k]
            p = np.where(known[of], root[at[of]], p)
        g = cls // FINE
        p = p * (a1 + d1 * s.coarse[1][g]) / (a1 + s.coarse[0][g])
        if held:
            p = np.where(mid >= 0, middle[np.maximum(mid, 0)], p)
        p = p * (a2 + d2 * s.fine[1][cls]) / (a2 + s.fine[0][cls])
        if held:
            p = np.where(low >= 0, fine[np.maximum(low, 0)], p)
        chances.append(p)
    return count, chances


def _chances(chunk: Chunk, parts: list[dict], samples: list[Totals]) -> tuple[np.ndarray, np.ndarray]:
    """Training count of each name of a chunk, and log10 of the averaged probability of each pair, from the answers of its buckets in order."""
    count = np.concatenate([p["count"] for p in parts]).astype(np.int64)
    tables, seated = (np.concatenate([p[k] for p in parts], 1).astype(np.int64) for k in ("tables", "seated"))
    n, chance = np.concatenate([p["n"] for p in parts]).astype(np.int64), np.concatenate([p["chance"] for p in parts], 1).astype(np.float64)
    _, fine = np.unique(chunk.word * CLASSES + chunk.cls[chunk.before], return_inverse=True)
    total, seen = np.zeros(n.size), count[chunk.before]  # a word is a context as often as it occurs
    for k, s in enumerate(samples):
        d, a = s.discounts[3], s.strengths[3]
        total += (n - d * seated[k] + (a + d * tables[k][chunk.before]) * chance[k][fine]) / (a + seen)
    return count, np.log10(total / len(samples))


def _lookup(keys: np.ndarray, wanted: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """The place of each wanted number in the sorted keys, -1 where it is missing."""
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return np.where(usable & (keys[at] == wanted), at, -1)


def scores(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, held_out, text).

    score is the log10 probability of the text's words and its end; base_score that of add-0.1 unigrams. Null and
    empty texts are the end token alone. A model fitted on no texts gives every token the one unknown's probability, 1.
    Repeated rows are scored each; an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(4, -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    doc_type = docs.schema["doc_id"].dataType
    n, v, samples, buckets = fitted.tokens, fitted.words, fitted.samples, fitted.buckets
    schema = f"doc_id {doc_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches):
        unpack = zstandard.ZstdDecompressor()
        for group in runs(batches, ["chunk"]):
            role = group.column("role").to_numpy()
            cut = int(np.searchsorted(role, TEXT))
            parts = [_load(b) for b in group.column("text").slice(0, cut).to_pylist()]
            rows, held = [], []
            for batch in group.slice(cut).to_batches():
                for part in _unpacked(batch, unpack):
                    data, offsets = raw(part.column("text"))
                    rows.append(part.select(["doc_id", "held_out"]))
                    held.append(tokens(LOWER[data], offsets))
            del group
            chunk = Chunk(held, buckets)
            held = [of for _, _, of in held]
            count, log = _chances(chunk, parts, samples)
            base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
            first = 0
            for part, of in zip(rows, held, strict=True):
                own = slice(first, first + of.size)
                name, pair, first, many = chunk.token[own], chunk.pair[own], own.stop, part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(of, minlength=many).astype(np.int64)),
                     pa.array(np.bincount(of, count[name] > 0, many).astype(np.int64)), pa.array(np.full(many, n, np.int64)),
                     pa.array(np.bincount(of, base[name], many)), pa.array(np.bincount(of, log[pair], many))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    done = []
    for i in range(ROUNDS):
        dealt = _packed(docs.select("doc_id", "held_out", chunk, "text").where(F.col("chunk") % ROUNDS == i))
        # requests go straight to their buckets: written as a table, they would stand on disk twice
        asked = _asked(dealt.repartition(chunks, "chunk").sortWithinPartitions("chunk"), fitted.buckets)
        answers = written(_answered(asked, fitted), "answers", "uncompressed")
        both = dealt.select("chunk", F.lit(TEXT).alias("role"), "doc_id", "held_out", "text").unionByName(answers.select(
            "chunk", F.col("bucket").alias("role"), F.lit(None).cast(doc_type).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
            F.col("blob").alias("text")))
        done.append(written(both.repartition(chunks, "chunk").sortWithinPartitions("chunk", "role").mapInArrow(score, schema), "scores"))
        discard(answers)
    return reduce(DataFrame.unionByName, done)


def _packed(docs: DataFrame) -> DataFrame:
    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))

    return docs.mapInArrow(pack, docs.withColumn("text", F.col("text").cast("binary")).schema)
