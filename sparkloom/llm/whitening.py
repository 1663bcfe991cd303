"""Operator 11, embedding whitening by the exact characteristic polynomial.

Entries become integers x = floor(64 c) + 1000000. With f = floor(64 c), n rows and sums S of f, the scatter
A = n * sum(f f') - S S' is an integer matrix, n * n times the covariance (the shift by 1000000 drops out). Its
characteristic polynomial is computed modulo primes by Hessenberg reduction, as many as a bound
of the coefficients asks for, and put together by Chinese remaindering: it is exact. All its roots are real
and none is negative, so by Descartes' rule the sign changes of its Taylor shift at a are exactly the roots above a:
bisection isolates them, and quadratic interval refinement brings each to ``BITS`` correct bits. A root's
component is the null space of A less the root, by inverse iteration in fixed point of the same precision;
roots that ``BITS`` bits can't tell apart get an orthonormal basis of their joint space.

Scale: the vectors are read three times and never shuffled. Each task sums its own rows' products exactly (in
limbs that float matrix products can't round) and sends d * (d + 1) / 2 of them, which Spark adds by
place as decimals; primes are dealt to tasks, and what reaches the driver has the size of the matrix, whatever
the number of rows. Only the roots are found on the driver, and the components one to a task.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; a shorter vector counts as
if filled up with zeros, ids may be null or repeated, and equal rows all count; floor(64 c) beyond
62 bits is taken as 2 ** 62 of its sign; a deviation beyond 63 bits is null. There are as many components as dimensions, 32 at most;
where the eigenvalue is 0 (a constant dimension, fewer rows than dimensions) ``explained`` is 0 and ``whitened`` null, and ``identity_error``
covers the other components (null without any); no vectors, or vectors without entries, give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Correct bits of roots, and of the arithmetic for their components.
BITS = 256
#: Entries of floor(64 c) lie within this.
MOST = 1 << 62
LIMB = 20


# --- integers from vectors -------------------------------------------------------------------------


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vector has no null or non-finite entry, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of a column of lists, rows by d, as int64; short rows are filled with zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        f = np.clip(np.floor(flat * SCALE), -float(MOST), float(MOST)).astype(np.int64)
    if len(lengths) and (lengths == d).all():
        return f.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(f)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = f
    return out


def gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers: products of limbs whose sums a double holds exactly."""
    limbs, rest = [], x
    while True:
        low = rest & ((1 << LIMB) - 1) if (np.abs(rest) >= 1 << LIMB).any() else rest
        limbs.append(low.astype(np.float64))
        if low is rest:
            break
        rest = (rest - low) >> LIMB
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            # Up to 2 ** 12 rows of products below 2 ** 40 at a time: below 2 ** 53.
            part = sum((a[k : k + 4096].T @ b[k : k + 4096]).astype(np.int64).astype(object) for k in range(0, len(x), 4096))
            out = out + (part << (LIMB * (i + j)) if len(x) else 0)
    return out


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of f and n * sum(f f') - sum f * sum f', all exact."""
    cells = d * (d + 1) // 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(batch.column(0), d)
            n += len(x)
            whole = x if len(x) * int(np.abs(x).max(initial=0)) < MOST else x.astype(object)
            sums = sums + whole.sum(0).astype(object)
            products = products + gram(x)
        values = [n, *sums, *products[np.triu_indices(d)]]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1 - d, cells), pa.int32()), pa.array([str(v) for v in values], pa.string())], names=["cell", "value"])

    told = rows.select("v").mapInArrow(add, "cell int, value string").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"))
    found = {r.cell: int(r.value) for r in told.collect()}  # one row a cell of the matrix
    n, sums = found.get(-1 - d, 0), [found.get(i - d, 0) for i in range(d)]
    a = [[0] * d for _ in range(d)]
    for cell, (i, j) in enumerate(zip(*np.triu_indices(d))):
        a[i][j] = a[j][i] = n * found.get(cell, 0) - sums[i] * sums[j]
    return n, sums, a


# --- the characteristic polynomial -----------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide below 3 * 10 ** 9."""
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    s = (n - 1 & 1 - n).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, n - 1 >> s, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(a: list[list[int]]) -> list[int]:
    """Primes below 2 ** 31 whose product is over twice every coefficient's bound.

    Roots are non-negative and sum to the trace, so the k-th coefficient is at most C(d, k) (trace / d) ** k.
    """
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    bound = max((math.comb(d, k) * (trace**k) // d**k + 1 for k in range(d + 1)), default=1)
    out, product, p = [], 1, (1 << 31) + 1
    while product <= 2 * bound + 2:
        p -= 2
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - a) modulo p, lowest first: similar Hessenberg form, then its recurrence."""
    h, d = a % p, len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        m = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - m[:, None] * h[k + 1]) % p
        # Each product is below 2 ** 62; sums are reduced product by product.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * m % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        nxt = np.roll(polys[k], 1)
        nxt = (nxt - h[k, k] * polys[k]) % p
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            nxt = (nxt - run * int(h[i, k]) % p * polys[i]) % p
        polys[k + 1] = nxt
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t - a), lowest first; one task takes some of the primes."""
    d, primes = len(a), primes_for(a)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [polynomial_mod(np.array([[x % p for x in row] for row in a], np.int64).reshape(d, d), p) for p in ps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 8 * spark.sparkContext.defaultParallelism) or 1)
    rows = dealt.mapInArrow(reduce, "p long, c array<long>").collect()  # one row a prime
    product = math.prod(primes)
    sums = [0] * (d + 1)
    for p, residues in rows:
        rest = product // p
        weight = rest * pow(rest, -1, p)
        sums = [(s + r * weight) % product for s, r in zip(sums, residues)]
    out = [s - product if 2 * s > product else s for s in sums]
    assert out[d] == 1 and (not d or out[d - 1] == -sum(a[i][i] for i in range(d))), "the polynomial doesn't hold the trace"
    return out


# --- its roots -------------------------------------------------------------------------------------


class Roots:
    """The real, non-negative roots of a monic integer polynomial, largest first."""

    def __init__(self, coefficients: list[int]):
        self.zeros = next(i for i, c in enumerate(coefficients) if c)  # the root 0 is told by the lowest coefficients
        self.c = coefficients[self.zeros :]
        self.d = len(self.c) - 1
        self.counts: dict[Fraction, int] = {}

    def scaled(self, k: int) -> list[int]:
        """Coefficients in 2 ** k t."""
        return [c << k * (self.d - i) for i, c in enumerate(self.c)]

    def above(self, at: Fraction) -> int:
        """How many roots are greater than a dyadic number: the sign changes of the shifted polynomial."""
        if at not in self.counts:
            k = at.denominator.bit_length() - 1
            q, m = self.scaled(k), at.numerator
            for i in range(self.d):
                for j in range(self.d - 1, i - 1, -1):
                    q[j] += m * q[j + 1]
            signs = [x > 0 for x in q if x]
            self.counts[at] = sum(a != b for a, b in zip(signs, signs[1:]))
        return self.counts[at]

    def value(self, at: Fraction) -> int:
        """The polynomial's value, times a power of two."""
        k, out = at.denominator.bit_length() - 1, 0
        for i, c in enumerate(reversed(self.c)):
            out = out * at.numerator + (c << k * i)
        return out

    def refined(self, low: Fraction, high: Fraction) -> Fraction:
        """The only root in (low, high], a simple one, to BITS correct bits."""
        if not self.value(high):
            return high
        while not self.value(low):  # the next smaller root is the open end itself
            middle = (low + high) / 2
            if not self.value(middle):
                return middle
            low, high = (middle, high) if self.above(middle) > self.above(high) else (low, middle)
        positive = self.value(high) > 0
        n = 2
        while low <= 0 or (high - low) * (1 << BITS) > low:
            width = (high - low) / (1 << n)
            # The secant's cell of 2 ** n equal ones; doubled at every hit, halved at every miss.
            a, b = Fraction(self.value(low), 1), Fraction(self.value(high), 1)
            a, b = a / (1 << self.d * (low.denominator.bit_length() - 1)), b / (1 << self.d * (high.denominator.bit_length() - 1))
            cell = min(max(round(a / (a - b) * (1 << n)), 1), (1 << n) - 1) if a != b else 1 << n - 1
            x = low + cell * width
            v = self.value(x)
            if not v:
                return x
            if (v > 0) == positive:
                other = x - width
                w = self.value(other)
                if not w:
                    return other
                hit = (w > 0) != positive
                low, high = (other, x) if hit else (low, other)
            else:
                other = x + width
                w = self.value(other)
                if not w:
                    return other
                hit = (w > 0) == positive
                low, high = (x, other) if hit else (other, high)
            n = min(2 * n, BITS) if hit else max(1, n // 2)
        return (low + high) / 2

    def largest(self, count: int) -> list[tuple[Fraction, int]]:
        """(root, multiplicity), largest first, that hold the ``count`` largest; roots BITS bits can't tell apart count as one."""
        out: list[tuple[Fraction, int]] = []
        top = Fraction(1 << max(1, (-self.c[-2]).bit_length())) if self.d else Fraction(1)
        todo = [(Fraction(0), top)] if self.d else []
        while todo and sum(m for _, m in out) < count:
            low, high = todo.pop()
            m = self.above(low) - self.above(high)
            if not m:
                continue
            if m == 1 and low > 0:
                out.append((self.refined(low, high), 1))
            elif low > 0 and (high - low) * (1 << BITS) <= low:
                out.append(((low + high) / 2, m))
            else:
                middle = (low + high) / 2
                todo += [(low, middle), (middle, high)]
        return out + ([(Fraction(0), self.zeros)] if self.zeros and sum(m for _, m in out) < count else [])


# --- its components --------------------------------------------------------------------------------


def null_space(a: list[list[int]], root: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal vectors that a maps to root times themselves, by inverse iteration in fixed point."""
    d, bits = len(a), BITS + 64
    if root == 0 and not any(map(any, a)):
        return np.eye(d)[:count]
    # Scaled so that the largest entry has ``bits`` bits after the point.
    size = max(abs(x) for row in a for x in row).bit_length()
    up = max(0, 2 * bits - size)
    shift = int(root * (1 << up))
    m = [np.array([(x << up) - (shift if i == j else 0) for j, x in enumerate(row)], object) for i, row in enumerate(a)]
    m = [row >> (size + up - bits) for row in m]
    order, factors = list(range(d)), [[0] * d for _ in range(d)]
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(m[i][k]))
        m[k], m[pivot], order[k], order[pivot] = m[pivot], m[k], order[pivot], order[k]
        factors[k], factors[pivot] = factors[pivot], factors[k]
        if not m[k][k]:
            m[k][k] = 1  # an exact null vector
        for i in range(k + 1, d):
            if m[i][k]:
                f = (m[i][k] << bits) // m[k][k]
                factors[i][k] = f
                m[i][k:] = m[i][k:] - ((f * m[k][k:]) >> bits)
                m[i][k] = 0

    def solved(b: list[int]) -> list[int]:
        y = [b[i] for i in order]
        for i in range(d):
            y[i] -= sum(factors[i][j] * y[j] >> bits for j in range(i) if factors[i][j])
        for i in range(d - 1, -1, -1):
            y[i] = ((y[i] - sum(m[i][j] * y[j] >> bits for j in range(i + 1, d))) << bits) // m[i][i]
        return y

    def orthonormal(vectors: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for v in vectors:
            most = max(max(map(abs, v)), 1).bit_length()
            v = [x << bits - most if bits > most else x >> most - bits for x in v]
            for u in out * 2:
                dot = sum(x * y for x, y in zip(u, v)) >> bits
                v = [x - (dot * y >> bits) for x, y in zip(v, u)]
            norm = max(math.isqrt(sum(x * x for x in v)), 1)
            out.append([(x << bits) // norm for x in v])
        return out

    rng = np.random.default_rng(11)
    found = [[int(x) << bits - 31 for x in rng.integers(1 << 29, 1 << 31, d)] for _ in range(count)]
    for _ in range(4):
        found = orthonormal([solved(v) for v in orthonormal(found)])
    out = np.array([[x / (1 << bits) for x in v] for v in found])
    return out * np.where(out[np.arange(count), np.abs(out).argmax(1)] < 0, -1, 1)[:, None]


def components(spark: SparkSession, a: list[list[int]], most: int = COMPONENTS) -> tuple[list[Fraction], np.ndarray]:
    """The scatter's largest roots, falling, and their unit vectors, a row each; one task a root."""
    roots = Roots(characteristic_polynomial(spark, a)).largest(most)
    tasks = [(i, str(r.numerator), str(r.denominator), m) for i, (r, m) in enumerate(roots)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, p, q, m in zip(*(c.to_pylist() for c in batch.columns)):
                found = null_space(a, Fraction(int(p), int(q)), m)
                yield pa.RecordBatch.from_arrays([pa.array([i] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["i", "k", "u"])

    dealt = spark.createDataFrame(tasks, "i int, p string, q string, m int").repartition(max(1, len(tasks)))
    rows = sorted(dealt.mapInArrow(solve, "i int, k int, u array<double>").collect())[:most]
    return [roots[r.i][0] for r in rows], np.array([r.u for r in rows]).reshape(len(rows), len(a))


# --- whitening -------------------------------------------------------------------------------------


def square_root(x: Fraction) -> float:
    """Correct to double precision, however large or small."""
    if not x:
        return 0.0
    k = max(0, 128 - x.numerator.bit_length() + x.denominator.bit_length())
    k += k & 1
    return float(Fraction(math.isqrt((x.numerator << k) // x.denominator), 1 << k // 2))


class Whitening:
    """What the fit gives: n, sums, eigenvalues of the scatter, components and their scale."""

    def __init__(self, n: int, sums: list[int], a: list[list[int]], roots: list[Fraction], vectors: np.ndarray):
        self.n, self.sums, self.d = n, np.array(sums, object), len(sums)
        trace = sum(a[i][i] for i in range(self.d))
        self.explained = [float(r / trace) if trace else 0.0 for r in roots]
        # (n x - S) projected, over n * sqrt(e) = sqrt(root): n times x - S / n over n times the deviation.
        self.scales = np.array([1 / square_root(r) if r else math.nan for r in roots])
        self.weights = vectors

    def offsets(self, f: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where it fits, else Python integers."""
        most = int(np.abs(f).max(initial=0)) * self.n + int(max(map(abs, self.sums), default=0))
        if most < MOST:
            return f * self.n - self.sums.astype(np.int64)
        return f.astype(object) * self.n - self.sums

    def deviation(self, off: np.ndarray) -> list[int | None]:
        if off.dtype == object or float(np.abs(off).max(initial=0)) ** 2 * self.d >= MOST:
            total = (off.astype(object) ** 2).sum(1)
            return [int(t) if t < 1 << 63 else None for t in total]
        return (off * off).sum(1).tolist()

    def whitened(self, off: np.ndarray) -> np.ndarray:
        return (off.astype(np.float64) @ self.weights.T) * self.scales


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """The whitening of all valid vectors."""
    rows = valid(vectors, id_col, vector_col)
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not d:
        return Whitening(0, [], [], [], np.zeros((0, 0)))
    n, sums, a = scatter(rows, d)
    roots, found = components(vectors.sparkSession, a, most)
    return Whitening(n, sums, a, roots, found)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity; rows are centred before they are multiplied."""
    held = np.flatnonzero(np.isfinite(model.scales))
    k = len(held)
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = model.whitened(model.offsets(integers(batch.column(0), model.d)))[:, held]
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    sums = rows.select("v").mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    error = F.abs(F.col("value") / model.n - F.when(F.col("cell") % (k + 1) == 0, 1.0).otherwise(0.0))
    return sums.agg(F.max(error)).first()[0]


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (an array, one entry a component) of every valid vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = model.offsets(integers(batch.column(1), model.d))
            z = model.whitened(off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel(), pa.float64(), mask=~np.isfinite(z.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(off), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    rows = valid(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not len(model.scales):
        return rows.where("false").selectExpr("vec_id", "cast(null as long) as deviation", "cast(null as array<double>) as whitened")
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def by_component(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each valid vector and component."""
    model = fit(vectors, id_col, vector_col)
    error = identity_error(valid(vectors, id_col, vector_col), model) if len(model.scales) else None
    rows = whiten(vectors, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(e) for e in model.explained)) if model.explained else F.array().cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
