"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter matrix.

Entries become integers, so the scatter n * sum(x x') - S S' of the distinct vectors is an integer matrix that tasks sum
exactly. Its characteristic polynomial is found modulo many primes by Hessenberg reduction, one task a share of the
primes, and put together by Chinese remaindering. All its roots are real, so the sign changes of a shifted polynomial
count the roots above a point exactly: bisection isolates the largest ones and refines them to 200 bits. Components span
the null spaces of scatter - root * I, found by inverse iteration in long decimals, one task a share of the roots.
The driver holds what has the size of the width's square, never of the table.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written

SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 53  # entries beyond are held there; doubles have no finer parts there anyway
BITS = 200  # of a root's relative precision
NEAR = 80  # roots that agree in so many bits are one root of higher multiplicity
DIGITS = 140  # of decimals in inverse iteration
BIG = pa.decimal128(38, 0)


def _product(rows: np.ndarray) -> np.ndarray:
    """rows' @ rows of integers, exact; the fastest arithmetic that holds the sums."""
    top = int(np.abs(rows).max(initial=0)) ** 2 * len(rows)
    if top < 1 << 53:
        wide = rows.astype(np.float64)
        return (wide.T @ wide).astype(np.int64)
    rows = rows.astype(object) if top >= 1 << 62 else rows
    return rows.T @ rows


def _matrix(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and matrix of the list column's rows, width by width."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends, sizes = ends - ends[0], np.diff(ends)
    for width in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == width)
        yield width, own, flat[ends[own][:, None] + np.arange(width)]


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each width: n, the sum of the distinct vectors, and their integer scatter n * sum(x x') - S S'."""

    def add(batches):
        total = {}
        for batch in batches:
            for width, _, rows in _matrix(batch.column("x")):
                wide = np.hstack([np.ones((len(rows), 1), np.int64), rows])  # row 0 of the product: n and the sums
                total[width] = total.get(width, 0) + _product(wide).astype(object)
        for width, sums in total.items():
            i, j = np.triu_indices(width + 1)
            values = [Decimal(int(v)) for v in sums[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * i.size, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, BIG)], ["width", "i", "j", "v"])

    rows = fit.select("x").mapInArrow(add, "width int, i int, j int, v decimal(38,0)").groupBy("width", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, dict] = {}
    for r in rows.collect():  # one row an entry of each width's matrix
        found.setdefault(r.width, {})[r.i, r.j] = int(r.v)
    out = {}
    for width, v in found.items():
        n, s = v[0, 0], [v[0, j + 1] for j in range(width)]
        out[width] = n, s, [[n * v[min(i, j) + 1, max(i, j) + 1] - s[i] * s[j] for j in range(width)] for i in range(width)]
    return out


def _is_prime(n: int) -> bool:
    """Exact for n below 3 * 10**9 (Miller and Rabin with bases 2, 3, 5 and 7)."""
    if n < 11 or not n % 2:
        return n in (2, 3, 5, 7)
    d, s = n - 1, 0
    while not d % 2:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def _primes(beyond: int) -> list[int]:
    """The largest primes below 2**31 whose product is beyond a bound."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= beyond:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo a prime below 2**31, highest first: Hessenberg form, then its recurrence."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not below.size:
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    rows = np.zeros((d + 1, d + 1), np.int64)  # rows[k]: polynomial of the leading k x k part, lowest coefficient first
    rows[0, 0] = 1
    chain = np.zeros(0, np.int64)  # products of subdiagonal entries from i + 1 to k
    for k in range(d):
        if k:
            chain = np.append(chain, 1) * h[k, k - 1] % p
        new = -(h[k, k] * rows[k]) % p
        new[1:] += rows[k, :-1]
        rows[k + 1] = (new - ((h[:k, k] * chain % p)[:, None] * rows[:k] % p).sum(0)) % p
    return rows[d, ::-1].copy()


def _shared_out(spark, items: list[tuple[int, str]], work, kind: str) -> list:
    """work(key, text) of each item, in tasks; the answers are small texts."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("given").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"key": [key], "given": [work(key, text)]}, pa.schema([("key", pa.int64()), ("given", pa.string())]))

    parts = min(len(items), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(items, "key long, given string").repartition(parts).mapInArrow(run, "key long, given string")
    return sorted((r.key, r.given) for r in rows.collect())


def characteristic(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - matrix), highest first, of a positive semidefinite integer matrix."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))  # symmetric means of the roots
    primes = _primes(2 * bound + 1)
    found = _shared_out(spark, [(p, "") for p in primes], lambda p, _: ",".join(map(str, polynomial_modulo(matrix, p).tolist())), "prime")
    modulus = math.prod(primes)
    total = [0] * (d + 1)
    for p, text in found:
        unit = modulus // p * pow(modulus // p, -1, p)
        total = [(t + int(r) * unit) % modulus for t, r in zip(total, text.split(","), strict=True)]
    return [t - modulus if 2 * t > modulus else t for t in total]


def _above(poly: list[int], a: int, k: int) -> int:
    """How many roots of a polynomial with real roots alone lie above a / 2**k: the sign changes of poly(x + a / 2**k)."""
    c = [v << (k * i) for i, v in enumerate(poly)]  # roots times 2**k
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += a * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int, k: int) -> int:
    value = 0
    for i, c in enumerate(poly):
        value = value * a + (c << (k * i))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """(a, k, times): the roots a / 2**k above 0, largest first, to BITS bits, until `most` roots are there.

    poly has integer coefficients, highest first, and real roots of at least 0 alone. Roots that agree in NEAR bits are given once.
    """
    while poly and not poly[-1]:
        poly = poly[:-1]  # zeros as roots
    top = -poly[1] if len(poly) > 1 else 0  # the sum of the roots
    found, open_ = [], [(0, top + 1, 0, len(poly) - 1, 0)]  # (low, high], k, roots above low, roots above high
    while open_:
        low, high, k, over_low, over_high = open_.pop()
        if over_low == over_high or over_high >= most:
            continue
        if over_low - over_high == 1 or low and (high - low) << NEAR < low:
            found.append((low, high, k, over_low - over_high))
            continue
        low, high, k = 2 * low, 2 * high, k + 1
        middle = (low + high) // 2
        over = _above(poly, middle, k)
        open_ += [(low, middle, k, over_low, over), (middle, high, k, over, over_high)]
    out = []
    for low, high, k, times in sorted(found, key=lambda f: -f[0] / 2 ** f[2]):
        right = _sign(poly, high, k) if times == 1 else 0
        if times == 1 and not right:
            low = high  # the root itself
        while low < high and (not low or (high - low) << BITS > low):
            low, high, k = 2 * low, 2 * high, k + 1
            middle = (low + high) // 2
            over = _above(poly, middle, k) > _above(poly, high, k) if times > 1 else (at := _sign(poly, middle, k)) and at != right
            if times == 1 and not at:
                low = high = middle
            else:
                low, high = (middle, high) if over else (low, middle)
        out.append((low + high, k + 1, times))
    return out


def null_vectors(matrix: list[list[int]], a: int, k: int, times: int) -> list[list[Decimal]]:
    """Orthonormal vectors that span the null space of matrix - a / 2**k * I, by inverse iteration from fixed vectors."""
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        d, root = len(matrix), Decimal(a) / Decimal(2) ** k
        lu = np.array([[Decimal(v) for v in row] for row in matrix], object)
        lu[np.arange(d), np.arange(d)] -= root
        tiny = max(abs(v) for v in lu.ravel()).scaleb(-DIGITS) or Decimal(1).scaleb(-DIGITS)
        order = np.arange(d)
        for i in range(d):
            pivot = i + int(np.argmax(np.abs(lu[i:, i])))
            lu[[i, pivot]], order[[i, pivot]] = lu[[pivot, i]], order[[pivot, i]]
            lu[i, i] = lu[i, i] or tiny
            if i + 1 < d:
                lu[i + 1 :, i] = lu[i + 1 :, i] / lu[i, i]
                lu[i + 1 :, i + 1 :] -= np.outer(lu[i + 1 :, i], lu[i, i + 1 :])
        random = np.random.default_rng(7)
        basis = [np.array([Decimal(float(v)) for v in random.normal(size=d)], object) for _ in range(times)]
        for _ in range(3):
            solved = []
            for v in basis:
                x = v[order]
                for i in range(1, d):
                    x[i] -= (lu[i, :i] * x[:i]).sum()
                for i in range(d - 1, -1, -1):
                    x[i] = (x[i] - ((lu[i, i + 1 :] * x[i + 1 :]).sum() if i + 1 < d else 0)) / lu[i, i]
                for _ in range(2):
                    for u in solved:
                        x = x - u * (u * x).sum()
                    x = x / (x * x).sum().sqrt()
                solved.append(x)
            basis = solved
        return [[+v for v in (x if x[int(np.argmax(np.abs(x)))] > 0 else -x)] for x in basis]


def components(spark, matrix: list[list[int]], most: int) -> tuple[list[Decimal], np.ndarray]:
    """The largest eigenvalues above 0 of an integer scatter matrix, and their unit vectors as rows, to double precision."""
    roots = largest_roots(characteristic(spark, matrix), most)
    if not roots:
        return [], np.zeros((0, len(matrix)))

    def solve(i, text):
        a, k, times = map(int, text.split(" "))
        return ";".join(",".join(repr(float(v)) for v in x) for x in null_vectors(matrix, a, k, times))

    found = _shared_out(spark, [(i, f"{a} {k} {t}") for i, (a, k, t) in enumerate(roots)], solve, "root")
    vectors = [[float(v) for v in x.split(",")] for _, text in found for x in text.split(";")]
    with decimal.localcontext(decimal.Context(prec=40)):
        values = [Decimal(a) / Decimal(2) ** k for a, k, t in roots for _ in range(t)]
    return values[:most], np.array(vectors[:most])


class Model:
    """What whitening needs of one width: n, S, unit vectors over root eigenvalue (of the covariance), explained shares."""

    def __init__(self, spark, n: int, sums: list[int], scatter: list[list[int]], most: int):
        self.n, self.sums = n, np.array(sums, object)
        trace = sum(scatter[i][i] for i in range(len(sums)))
        values, vectors = components(spark, scatter, most)
        self.explained = [float(v / trace) for v in values]
        self.axes = vectors / np.array([float(v.sqrt() / n) for v in values]).reshape(-1, 1)

    def off(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        small = (int(np.abs(rows).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)) < 1 << 62
        return rows * self.n - self.sums.astype(np.int64) if small else rows.astype(object) * self.n - self.sums

    def white(self, rows: np.ndarray) -> np.ndarray:
        return (self.off(rows).astype(np.float64) / self.n) @ self.axes.T

    def deviations(self, rows: np.ndarray) -> list[int]:
        off = self.off(rows)
        if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) >= 1 << 62:
            off = off.astype(object)
        return [int(v) for v in (off * off).sum(1)]


def _identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Of each width, the largest entry of the whitened fit list's covariance minus the identity; means first, then centred products."""

    def summed(values):
        """Sums over rows of values(width, rows), an array of the size of the components (squared)."""

        def add(batches):
            total = {}
            for batch in batches:
                for width, _, rows in _matrix(batch.column("x")):
                    if width in models:
                        total[width] = total.get(width, 0.0) + values(width, rows).ravel()
            for width, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([width] * v.size, pa.int32()), pa.array(np.arange(v.size), pa.int32()), pa.array(v, pa.float64())], ["width", "i", "v"])

        out: dict[int, list[float]] = {}
        for r in fit.select("x").mapInArrow(add, "width int, i int, v double").groupBy("width", "i").agg(F.sum("v").alias("v")).orderBy("width", "i").collect():
            out.setdefault(r.width, []).append(r.v / models[r.width].n)
        return {w: np.array(v) for w, v in out.items()}

    means = summed(lambda width, rows: models[width].white(rows).sum(0))

    def products(width, rows):
        centred = models[width].white(rows) - means[width]
        return centred.T @ centred

    return {w: float(np.abs(v.reshape(len(means[w]), -1) - np.eye(len(means[w]))).max()) for w, v in summed(products).items()}


def whitened(vectors: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component: key, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    Entries c become x = floor(64 * c) + 1000000 (held at +-2**53 before the shift). The fit list has each distinct x vector
    once; a repeated row counts once there but has rows of its own in the result. Components are the unit eigenvectors of
    the fit list's covariance for the largest `most` eigenvalues, from 1; eigenvalues of 0 have none, so fewer come for
    narrow, few or flat vectors, and none for a single distinct vector. Equal eigenvalues get orthonormal vectors of their space.
    deviation is the exact sum of (n * x - S)**2, null where no long holds it; deviation_exact has it as a decimal (null from
    39 digits on). Vectors that are null or hold null or non-finite entries give no rows; each width is fitted on its own,
    and vectors without entries give none. Null and repeated keys are kept as they are. Other columns are not read; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    least, greatest = F.lit(float(-LIMIT)), F.lit(float(LIMIT))
    entry = lambda c: F.floor(F.greatest(least, F.least(greatest, c.cast("double") * SCALE)))
    clean = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(whole).select(
        F.col(key), F.transform(vector, entry).alias("x"))  # without the shift, which no difference sees
    fit = written(clean.select("x").distinct(), "fit")
    models = {w: m for w, s in _sums(fit).items() if len((m := Model(spark, *s, most)).explained)}
    errors = _identity_errors(fit, models)
    discard(fit)
    schema = vectors.select(key).schema.simpleString()[7:-1]
    out = f"{schema}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)".replace(f"{key}:", f"`{key}` ", 1)

    def rows(batches):
        for batch in batches:
            for width, own, x in _matrix(batch.column("x")):
                m = models.get(width)
                for at in range(0, len(own) if m else 0, 1000):
                    yield m_rows(batch, m, errors[width], own[at : at + 1000], x[at : at + 1000])

    def m_rows(batch, m, error, own, x):
        k = len(m.explained)
        sums = m.deviations(x)
        exact = pa.array([Decimal(v) if v < 10**38 else None for v in sums], BIG)
        again = pa.array(np.repeat(np.arange(len(own)), k))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(own)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(again), m.n)),
             pa.array([v if v < 1 << 63 else None for v in sums], pa.int64()).take(again), pa.array(m.white(x).ravel()),
             pa.array(np.tile(m.explained, len(own))), pa.array(np.full(len(again), error)), exact.take(again)],
            [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return clean.mapInArrow(rows, out)
