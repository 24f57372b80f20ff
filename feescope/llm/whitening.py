"""Whitening by the exact characteristic polynomial of the integer scatter matrix.

Vectors become whole numbers (``floor(64 * c)``), so the scatter matrix A = n * sum(x x^T) - S S^T over the distinct
vectors is exact; V = A / n^2 is their covariance. Its characteristic polynomial is computed modulo many primes, by
Hessenberg reduction, in parallel tasks, and put together by Chinese remainders. All roots are real, so the sign changes of the
shifted polynomial count the roots above any point exactly (Budan and Fourier): bisection isolates the greatest roots,
multiple ones included, and refines them to hundreds of bits. Components are null vectors of A - eigenvalue, by inverse
iteration with as many digits as the gap to the next root asks for, a task a root.

The vectors themselves are only grouped (to be distinct), summed and multiplied in tasks. The driver and the broadcasts hold
what the dimension alone bounds: d^2 sums, a residue per prime and coefficient, d x k components.

Defined results: rows whose vector is null, empty or holds null or non-finite entries take no part, nor do vectors of another
length than the most common (the longer one of equally common); rows equal in all columns all get a result; a null vec_id
stays null; components without variance cannot be scaled to one and are left out, so one distinct vector gives no rows, like an empty
table; entries beyond 2^55 in size count as that; a ``deviation`` beyond 38 digits is null. Other columns are not read.
"""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from feescope.llm.common import stored

SCALE = 64
_MOST = 1 << 61
_LIMB = 20  # bits of a factor: products of 2^13 rows stay below 2^53
_PART = 40  # bits of the parts in which sums travel


# --- whole-number vectors ----------------------------------------------------------


def whole_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """``floor(64 * c)`` of every vector that takes part, else None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.values.cast(pa.float64()).fill_null(np.nan), np.float64)
    offsets = np.asarray(column.offsets)
    valid = np.asarray(column.is_valid())
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.floor(np.nan_to_num(values, nan=0.0) * SCALE), -_MOST, _MOST).astype(np.int64)
    return [
        whole[a:b] if ok and b > a and bad[a] == bad[b] else None
        for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist())
    ]


def _packed(y: np.ndarray) -> bytes:
    """The same bytes for equal vectors only: the first byte tells the width."""
    small = y.min() >= -(1 << 15) and y.max() < 1 << 15
    return b"\2" + y.astype("<i2").tobytes() if small else b"\x08" + y.astype("<i8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def _whole_rows(batches):
    for batch in batches:
        found = [y for y in whole_vectors(batch.column(0)) if y is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(y) for y in found], pa.int32()), pa.array([_packed(y) for y in found], pa.binary())], ["dim", "x"]
        )


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in Python integers, by float products of parts small enough to be exact."""
    most = max(1, int(np.abs(y).max(initial=1)))
    if most < 1 << 24:
        parts, rows = [y.astype(np.float64)], max(1, (1 << 53) // most**2)
    else:
        parts, rest, rows = [], y, 1 << 13
        while ((rest != 0) & (rest != -1)).any():
            parts.append((rest & ((1 << _LIMB) - 1)).astype(np.float64))
            rest = rest >> _LIMB
        parts.append(rest.astype(np.float64))  # what is left is the sign
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                block = (a[at : at + rows].T @ b[at : at + rows]).astype(np.int64).astype(object)
                total += block << (_LIMB * (i + j)) if i + j else block
    return total


def _moments(dim: int):
    """Sums of the products of (1, x) with itself over a partition, cell by cell, in parts of ``_PART`` bits."""
    rows, cols = np.triu_indices(dim + 1)

    def run(batches):
        total = np.zeros((dim + 1, dim + 1), object)
        for batch in batches:
            if batch.num_rows:
                y = np.stack([_unpacked(x) for x in batch.column(0).to_pylist()])
                total += exact_products(np.hstack([np.ones((len(y), 1), np.int64), y]))
        cells, places, values = [], [], []
        for cell, value in enumerate(total[rows, cols].tolist()):
            place = 0
            while value:
                last = abs(value) < 1 << 62
                cells.append(cell)
                places.append(place)
                values.append(value if last else value & ((1 << _PART) - 1))
                value = 0 if last else value >> _PART
                place += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), pa.array(places, pa.int32()), pa.array(values, pa.int64())], ["cell", "place", "value"]
        )

    return run


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and sums of products of the packed vectors in ``fit`` (x), exactly."""
    parts = fit.select("x").mapInArrow(_moments(dim), "cell int, place int, value long")
    total = np.zeros((dim + 1, dim + 1), object)
    rows, cols = np.triu_indices(dim + 1)
    summed = parts.groupBy("cell", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    for r in summed.collect():  # (d + 1) (d + 2) / 2 cells
        total[rows[r.cell], cols[r.cell]] += int(r.value) << (_PART * r.place)
    total[cols, rows] = total[rows, cols]
    return int(total[0, 0]), total[0, 1:].tolist(), total[1:, 1:]


# --- characteristic polynomial -------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller and Rabin with bases that are enough below 3.4e14."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x in (0, 1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The greatest primes below 2^31 with a product of over ``bits`` bits."""
    found, at, have = [], (1 << 31) - 1, 0
    while have <= bits:
        if _is_prime(at):
            found.append(at)
            have += 30
        at -= 2
    return found


def modular_polynomial(matrix: np.ndarray, prime: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo ``prime``, from t^0 up, by reduction to Hessenberg form."""
    h = (matrix % prime).astype(np.int64)
    d = len(h)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        k = j + 1 + int(below[0])
        if k != j + 1:
            h[[k, j + 1]] = h[[j + 1, k]]
            h[:, [k, j + 1]] = h[:, [j + 1, k]]
        ratio = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, prime) % prime
        h[j + 2 :] = (h[j + 2 :] - ratio[:, None] * h[j + 1] % prime) % prime
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * ratio % prime).sum(1)) % prime
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        p = np.roll(polys[k - 1], 1) - h[k - 1, k - 1] * polys[k - 1] % prime
        product = 1
        for i in range(1, k):
            product = product * int(h[k - i, k - i - 1]) % prime
            p = p - (product * int(h[k - i - 1, k - 1]) % prime) * polys[k - i - 1] % prime
        polys[k] = p % prime
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(t - matrix), from t^0 up, of a positive semidefinite matrix of Python integers.

    All are below (1 + trace / d)^d, so primes whose product is over twice that give them with their signs.
    """
    d = len(matrix)
    bound = (1 + int(np.trace(matrix)) // d + 1) ** d
    primes = primes_for(bound.bit_length() + 2)
    shared = spark.sparkContext.broadcast(matrix)

    def residues(batches):
        for batch in batches:
            chosen = batch.column(0).to_pylist()
            found = [modular_polynomial(shared.value, p) for p in chosen]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["prime", "residues"])

    tasks = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), 64), "prime")
    rows = tasks.mapInArrow(residues, "prime long, residues array<long>").collect()
    values, modulus = [0] * (d + 1), 1
    for row in sorted(rows, key=lambda r: -r.prime):
        inverse = pow(modulus, -1, row.prime)
        values = [v + modulus * ((r - v) * inverse % row.prime) for v, r in zip(values, row.residues)]
        modulus *= row.prime
    return [v - modulus if 2 * v > modulus else v for v in values]


# --- roots ---------------------------------------------------------------------------


def _primitive(p: list[int]) -> list[int]:
    """Without leading zeros and common factors, from t^0 up."""
    while p and not p[-1]:
        p = p[:-1]
    common = math.gcd(*p) if p else 1
    return [c // common for c in p] if common > 1 else p


def _pseudo_rest(a: list[int], b: list[int]) -> list[int]:
    while len(a) >= len(b) and a:
        lead, shift = a[-1], len(a) - len(b)
        a = [b[-1] * c for c in a]
        for i, c in enumerate(b):
            a[shift + i] -= lead * c
        a = _primitive(a)
    return a


def _derivative(p: list[int]) -> list[int]:
    return [i * c for i, c in enumerate(p)][1:]


def _simple_mod(p: list[int], prime: int = (1 << 61) - 1) -> bool:
    """Whether p has no repeated root modulo ``prime``; then it has none at all."""
    a, b = [c % prime for c in p], [c % prime for c in _derivative(p)]
    while True:
        while b and not b[-1]:
            b.pop()
        if not b:
            return len(a) == 1
        inverse = pow(b[-1], -1, prime)
        while len(a) >= len(b):
            factor, shift = a[-1] * inverse % prime, len(a) - len(b)
            for i, c in enumerate(b):
                a[shift + i] = (a[shift + i] - factor * c) % prime
            while a and not a[-1]:
                a.pop()
        a, b = b, a


def simple_part(p: list[int]) -> list[int]:
    """A polynomial with the roots of p, each once."""
    if _simple_mod(p):
        return p
    a, b = _primitive(p), _primitive(_derivative(p))
    while b:
        a, b = b, _pseudo_rest(a, b)
    quotient, rest = [Fraction(0)] * (len(p) - len(a) + 1), [Fraction(c) for c in p]
    for i in reversed(range(len(quotient))):
        quotient[i] = rest[i + len(a) - 1] / a[-1]
        for j, c in enumerate(a):
            rest[i + j] -= quotient[i] * c
    common = math.lcm(*[c.denominator for c in quotient])
    found = _primitive([int(c * common) for c in quotient])
    return found if found[-1] > 0 else [-c for c in found]


def roots_above(p: list[int], at: int, scale: int) -> int:
    """How many roots of p, all of them real, are above at / 2^scale: the sign changes of p(t + at)."""
    d = len(p) - 1
    c = [v << (scale * (d - i)) for i, v in enumerate(p)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


@dataclass(frozen=True)
class Root:
    """The root in (low, low + 1] / 2^scale, the ``rank``-th greatest different one, and how often it occurs."""

    low: int
    scale: int
    rank: int
    times: int


def _finer(low: int, high: int, scale: int) -> tuple[int, int, int]:
    return (low, high, scale) if high - low > 1 else (2 * low, 2 * high, scale + 1)


def greatest_roots(p: list[int], wanted: int) -> list[Root]:
    """The greatest positive roots, until ``wanted`` are there with their repeats; p has real roots from 0 up only."""
    simple = simple_part(p)
    high = -p[-2] // p[-1] + 1 if len(p) > 1 else 1  # beyond the sum of all roots
    found, open_ = [], [(0, high, 0, 0, roots_above(simple, 0, 0))]
    have = 0
    while open_ and have < wanted:
        low, high, scale, above, n = open_.pop()  # n different roots in (low, high], ``above`` beyond
        if not n:
            continue
        if n == 1 and high - low == 1:
            times = roots_above(p, low, scale) - roots_above(p, high, scale) if simple is not p else 1
            found.append(Root(low, scale, above + 1, times))
            have += times
            continue
        low, high, scale = _finer(low, high, scale)
        middle = (low + high) // 2
        upper = roots_above(simple, middle, scale) - above
        open_.append((low, middle, scale, above + upper, n - upper))
        open_.append((middle, high, scale, above, upper))
    return found


def refined(simple: list[int], root: Root, bits: int) -> Root:
    """The root within 2^-bits. Signs tell the side: beyond it, ``rank - 1`` roots are left."""
    low, high, scale = root.low, root.low + 1, root.scale
    d = len(simple) - 1
    while scale < bits:
        low, high, scale = 2 * low, 2 * high, scale + 1
        middle, value = low + 1, 0
        for i in range(d, -1, -1):
            value = value * middle + (simple[i] << (scale * (d - i)))
        if not value or (value > 0) == (root.rank % 2 == 1):
            high = middle
        else:
            low = middle
    return Root(low, scale, root.rank, root.times)


def separated(simple: list[int], root: Root, trace: int) -> tuple[Root, int]:
    """The root and j such that no other is within trace / 2^j; the root is known to trace / 2^(2j + 128)."""
    top = trace.bit_length()
    for j in range(8, 1 << 20, 8):
        root = refined(simple, root, max(0, j + 4 - top))
        reach = max(1, -(-(trace << root.scale) // (1 << j))) if root.scale else -(-trace // (1 << j))
        low, high = max(0, root.low - reach), root.low + 1 + reach
        alone = roots_above(simple, low, root.scale) - roots_above(simple, high, root.scale) == 1
        if alone and (root.low > reach or simple[0]):
            return refined(simple, root, max(0, 2 * j + 128 - top)), j
    raise ArithmeticError("roots cannot be told apart")


# --- components ------------------------------------------------------------------------


def _solve_in_place(lower: np.ndarray, swaps: list[int], b: np.ndarray) -> np.ndarray:
    d = len(lower)
    for j in range(d):
        b[[j, swaps[j]]] = b[[swaps[j], j]]
        b[j + 1 :] = b[j + 1 :] - lower[j + 1 :, j] * b[j]
    for j in reversed(range(d)):
        b[j] = b[j] / lower[j, j]
        b[:j] = b[:j] - lower[:j, j] * b[j]
    return b


def null_vectors(matrix: np.ndarray, root: Root, gap_bits: int, rounds: int = 2) -> list[np.ndarray]:
    """``root.times`` orthonormal eigenvectors, by inverse iteration in decimal arithmetic of enough digits."""
    trace = int(np.trace(matrix))
    with decimal.localcontext() as context:
        context.prec = int((2 * gap_bits + 320) * 0.302) + 20
        unit = Decimal(trace)
        shift = Decimal(2 * root.low + 1) / Decimal(1 << (root.scale + 1)) / unit
        lower = np.array([[Decimal(int(x)) / unit for x in row] for row in matrix], object)
        d = len(lower)
        for j in range(d):
            lower[j, j] -= shift
        tiny = Decimal(10) ** -(context.prec - 25)
        swaps = []
        for j in range(d):
            k = j + int(np.argmax(np.abs(lower[j:, j])))
            swaps.append(k)
            if k != j:
                lower[[j, k], :] = lower[[k, j], :]
            if abs(lower[j, j]) < tiny:
                lower[j, j] = tiny
            lower[j + 1 :, j] = lower[j + 1 :, j] / lower[j, j]
            lower[j + 1 :, j + 1 :] = lower[j + 1 :, j + 1 :] - np.outer(lower[j + 1 :, j], lower[j, j + 1 :])
        rng = np.random.default_rng(1)
        basis = [np.array([Decimal(int(x)) for x in rng.integers(1, 1 << 20, d)], object) for _ in range(root.times)]
        for _ in range(rounds):
            solved = []
            for b in basis:
                x = _solve_in_place(lower, swaps, b.copy())
                x = x / max(abs(v) for v in x)
                for _ in range(2):
                    for other in solved:
                        x = x - (x * other).sum() * other
                    x = x / (x * x).sum().sqrt()
                solved.append(x)
            basis = solved
        found = [np.array([float(v) for v in x]) for x in basis]
    return [v if v[np.argmax(np.abs(v))] > 0 else -v for v in found]


def components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> list[tuple[Fraction, np.ndarray]]:
    """(eigenvalue, unit vector) of the ``wanted`` greatest positive eigenvalues, falling; a task a different one."""
    whole = characteristic_polynomial(spark, matrix)
    zeros = next(i for i, c in enumerate(whole) if c)
    p = whole[zeros:]
    if len(p) == 1:
        return []
    found = greatest_roots(p, wanted)
    shared = spark.sparkContext.broadcast((matrix, simple_part(p), int(np.trace(matrix)), zeros))

    def solve(batches):
        matrix, simple, trace, zeros = shared.value
        if zeros:
            simple = [0, *simple]  # zero is a root too, and so a neighbour
        for batch in batches:
            lows, scales, times, values, vectors = [], [], [], [], []
            for low, scale, rank, n in zip(*[c.to_pylist() for c in batch.columns]):
                root, gap = separated(simple, Root(int(low), scale, rank, n), trace)
                for v in null_vectors(matrix, root, gap):
                    lows.append(str(2 * root.low + 1))
                    scales.append(root.scale + 1)
                    times.append(rank)
                    vectors.append(v.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lows, pa.string()),
                    pa.array(scales, pa.int32()),
                    pa.array(times, pa.int32()),
                    pa.array(vectors, pa.list_(pa.float64())),
                ],
                ["value", "scale", "rank", "vector"],
            )

    rows = [(str(r.low), r.scale, r.rank, r.times) for r in found]
    tasks = spark.createDataFrame(rows, "low string, scale int, rank int, times int").repartition(len(rows), "rank")
    solved = tasks.mapInArrow(solve, "value string, scale int, rank int, vector array<double>").collect()
    solved.sort(key=lambda r: (r.rank, r.vector))
    return [(Fraction(int(r.value), 1 << r.scale), np.array(r.vector)) for r in solved][:wanted]


# --- the operator -------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, the whole and the broken part of their mean, and the components scaled to unit variance."""

    n: int
    dim: int
    base: np.ndarray
    rest: list[int]
    directions: np.ndarray
    explained: list[float]
    identity_error: float

    def project(self, y: np.ndarray) -> np.ndarray:
        fraction = np.array([float(Fraction(r, self.n)) for r in self.rest])
        return ((y - self.base) - fraction) @ self.directions

    def deviations(self, y: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        away = y - self.base
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if most**2 * self.dim < 1 << 62:
            return ((away * self.n - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        return ((away.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(1).tolist()


def _second_moments(model):
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                z = model.value.project(np.stack([_unpacked(x) for x in batch.column(0).to_pylist()]))
                z = np.hstack([np.ones((len(z), 1)), z])
                total = z.T @ z + (0 if total is None else total)
        if total is not None:
            cells = np.arange(total.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "value"])

    return run


def fit(rows: DataFrame, column: str = "embedding", most: int = 16) -> Whitening | None:
    """Components of the distinct vectors; None without any vector that takes part."""
    spark = rows.sparkSession
    whole = rows.select(F.col(column)).mapInArrow(_whole_rows, "dim int, x binary")
    distinct = stored(whole.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("n_rows")), "distinct")
    common = distinct.groupBy("dim").agg(F.sum("n_rows").alias("n_rows")).orderBy(F.desc("n_rows"), F.desc("dim")).first()
    if common is None:
        return None
    d = common.dim
    chosen = distinct.filter(F.col("dim") == d).select("x")
    n, sums, products = moments(chosen, d)
    s = np.array(sums, object)
    scatter = n * products - np.outer(s, s)
    trace = int(np.trace(scatter))
    found = components(spark, scatter, min(most, d)) if trace else []
    base = s // n
    scaled = [v / math.sqrt(Fraction(value, n * n)) for value, v in found]
    directions = np.stack(scaled, axis=1) if scaled else np.zeros((d, 0))
    explained = [float(value / trace) for value, _ in found]
    model = Whitening(n, d, base.astype(np.int64), (s - n * base).tolist(), directions, explained, 0.0)
    if not found:
        return model
    k = len(found) + 1
    shared = spark.sparkContext.broadcast(model)
    total = np.zeros(k * k)
    for r in chosen.mapInArrow(_second_moments(shared), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r.cell] = r.value / n
    total = total.reshape(k, k)
    error = np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k - 1)).max()
    return Whitening(n, d, model.base, model.rest, directions, explained, float(error))


def whiten(rows: DataFrame, model: Whitening | None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key``, ``deviation`` and the ``whitened`` components of every row whose vector takes part; nothing shuffles."""
    schema = f"{key} long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, wide = shared.value, 10**38
        for batch in batches:
            found = [(i, y) for i, y in enumerate(whole_vectors(batch.column(1))) if y is not None and len(y) == model.dim]
            if not found:
                continue
            y = np.stack([y for _, y in found])
            z = model.project(y)
            away = [Decimal(v) if v < wide else None for v in model.deviations(y)]
            offsets = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32) if z.shape[1] else np.zeros(len(y) + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([i for i, _ in found])),
                    pa.array(away, pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel())),
                ],
                [key, "deviation", "whitened"],
            )

    return rows.select(F.col(key).cast("long"), F.col(column)).mapInArrow(run, schema)


def whitened_components(rows: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 16) -> DataFrame:
    """One row per vector and component, numbered from 1. ``deviation`` is null where a long cannot hold it."""
    model = fit(rows, column, most)
    wide = whiten(rows, model, column, key)
    explained = F.array(*[F.lit(x) for x in (model.explained if model else [])]).cast("array<double>")
    long = wide.select(key, F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
