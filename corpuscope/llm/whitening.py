"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

1. Entries become integers ``x``; the fit list is each distinct vector once. Spark sums its
   first and second moments exactly: matrix products of limbs that stay below 2^53,
   then sums of limb columns per matrix cell.
2. The scatter ``A = n * sum(x x') - S S'`` (n^2 times the covariance) is an integer matrix. Its
   characteristic polynomial is found modulo many 31-bit primes (Hessenberg reduction, one
   prime a row of a Spark job) and put together by Chinese remaindering, as many primes as a proven bound of its coefficients asks.
3. All roots are real, so Descartes' rule counts them exactly: as many lie above ``a`` as the coefficients of ``p(x + a)`` change
   sign. Bisection on that count isolates each root, to ``ROOT_BITS`` bits; equal roots stay together.
4. Null-space inverse iteration in extended precision gives the eigenvectors, orthogonalised inside close roots.

The driver holds dim x dim matrices only, whatever the number of rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import cut_lineage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMB_BITS, BLOCK_ROWS, CELL_BITS = 16, 1 << 16, 30
#: bits of a root relative to the largest one
ROOT_BITS = 80
LONG = (-(1 << 63), (1 << 63) - 1)


# -- rows ---------------------------------------------------------------------------------
def integer_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, x array<long>`` of the usable rows: no null vector, no null or non-finite entry, not empty."""
    entry = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    limit = float(1 << 62)
    x = F.transform(entry, lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c * SCALE))) + SHIFT)
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed base-2^16 digits of integers as float64, as many as the largest needs."""
    out, rest = [], y.copy()
    while True:
        if not rest.any() and out:
            return out
        low = ((rest + (1 << (LIMB_BITS - 1))) & ((1 << LIMB_BITS) - 1)) - (1 << (LIMB_BITS - 1))
        out.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB_BITS


def block_moments(y: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact column sums and cross products (Python integers) of up to ``BLOCK_ROWS`` rows."""
    parts = limbs(y)
    dim = y.shape[1]
    first, second = np.zeros(dim, object), np.zeros((dim, dim), object)
    for i, a in enumerate(parts):
        first = first + np.array([int(v) for v in a.sum(axis=0)], object) * (1 << (LIMB_BITS * i))
        for j, b in enumerate(parts):  # below 2^15 * 2^15 * 2^16 = 2^46: exact in doubles
            second = second + (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB_BITS * (i + j)))
    return list(first), second


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and cross products of ``x - SHIFT`` over the fit list, exact.

    A task sends one row for each cell and limb; the driver receives dim * (dim + 3) / 2 cells.
    """
    cells = [(i, j) for i in range(dim) for j in range(i, dim)]

    def run(batches):
        n, first, second = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            y = matrix_of(batch["x"], dim) - SHIFT
            for at in range(0, len(y), BLOCK_ROWS):
                a, b = block_moments(y[at:at + BLOCK_ROWS])
                n, first, second = n + len(y[at:at + BLOCK_ROWS]), first + np.array(a, object), second + b
        if not n:
            return
        cell, limb, value = [], [], []
        for c, v in enumerate([n, *first, *(second[i, j] for i, j in cells)]):
            v, sign, k = abs(int(v)), 1 if v >= 0 else -1, 0
            while v or not k:
                cell.append(c), limb.append(k), value.append(sign * (v & ((1 << CELL_BITS) - 1)))
                v, k = v >> CELL_BITS, k + 1
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "limb": pa.array(limb, pa.int32()), "value": pa.array(value, pa.int64())})

    total = [0] * (1 + dim + len(cells))
    for cell, limb, value in fit.mapInArrow(run, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect():
        total[cell] += value << (CELL_BITS * limb) if value >= 0 else -((-value) << (CELL_BITS * limb))
    second = np.zeros((dim, dim), object)
    for (i, j), v in zip(cells, total[1 + dim:]):
        second[i, j] = second[j, i] = v
    return total[0], total[1:1 + dim], second


def scatter_matrix(n: int, first: list[int], second: np.ndarray) -> np.ndarray:
    """n^2 times the covariance, in integers; the shift cancels."""
    s = np.array(first, object)
    return second * n - np.outer(s, s)


# -- characteristic polynomial --------------------------------------------------------------
def is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):  # enough below 3 215 031 751
        x = pow(a, d, n)
        if x not in (1, n - 1) and a % n:
            for _ in range(r - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
    return True


def primes_over(bits: int) -> list[int]:
    """Primes below 2^31, from the top, whose product has more than ``bits`` bits."""
    out, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def hessenberg_polynomial(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo ``p``, lowest first, of det(xI - a); ``a`` holds residues below 2^31."""
    h, n = a.astype(np.int64) % p, len(a)
    for j in range(n - 2):
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        pivot = j + 1 + int(below[0])
        if pivot != j + 1:
            h[[j + 1, pivot]] = h[[pivot, j + 1]]
            h[:, [j + 1, pivot]] = h[:, [pivot, j + 1]]
        u = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - u[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(n):
        new = np.zeros(n + 1, np.int64)
        new[1:] = polys[k, :-1]
        new = (new - h[k, k] * polys[k]) % p
        weight, factors = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            weight = weight * int(h[i + 1, i]) % p
            factors[i] = int(h[i, k]) * weight % p
        if k:
            new = (new - (factors[:, None] * polys[:k] % p).sum(axis=0)) % p
        polys[k + 1] = new
    return polys[n]


def coefficient_bits(trace: int, dim: int) -> int:
    """Bits of the largest coefficient: the k-th is at most C(dim, k) * (trace / dim)^k (roots not negative)."""
    best = 0.0
    step = math.log2(trace) - math.log2(dim) if trace else 0.0
    for k in range(dim + 1):
        best = max(best, (math.lgamma(dim + 1) - math.lgamma(k + 1) - math.lgamma(dim - k + 1)) / math.log(2) + k * step)
    return int(best) + 8


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients, lowest first, of det(xI - a) for a positive semi-definite integer matrix."""
    dim = len(a)
    primes = primes_over(coefficient_bits(sum(int(a[i, i]) for i in range(dim)), dim) + 1)
    flat = [str(int(v)) for v in a.ravel()]

    def run(batches):
        matrix = np.array([int(v) for v in flat], object).reshape(dim, dim)
        for batch in batches:
            own = batch["p"].to_pylist()
            polys = [hessenberg_polynomial((matrix % p).astype(np.int64), p) for p in own]
            yield pa.RecordBatch.from_arrays([batch["p"], pa.array([c.tolist() for c in polys], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    residues = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    total, modulus = [0] * (dim + 1), 1
    for p, c in sorted(residues):
        inverse = pow(modulus % p, -1, p)
        total = [t + modulus * ((r - t) * inverse % p) for t, r in zip(total, c)]
        modulus *= p
    return [t - modulus if 2 * t > modulus else t for t in total]


# -- roots ----------------------------------------------------------------------------------
def shifted(poly: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    out = list(poly)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += a * out[j + 1]
    return out


def roots_above(poly: list[int], a: int) -> int:
    """Roots greater than ``a``, with multiplicity, of a polynomial whose roots are all real."""
    signs = [c > 0 for c in shifted(poly, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def scaled(poly: list[int], bits: int) -> list[int]:
    """Polynomial whose roots are 2^bits times those of ``poly`` (monic)."""
    n = len(poly) - 1
    return [c << (bits * (n - k)) for k, c in enumerate(poly)]


def rounded_roots(poly: list[int], wanted: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The ``wanted`` largest positive roots, falling, each within 2^-bits of the largest one's size."""
    rank = roots_above(poly, 0)
    wanted = min(wanted, rank)
    if not wanted:
        return []
    top = -poly[-2]  # all roots together
    up = max(0, bits - top.bit_length() + len(poly).bit_length())
    fine = scaled(poly, up)
    counted: dict[int, int] = {0: rank, (top << up): 0}

    def above(a: int) -> int:
        if a not in counted:
            counted[a] = roots_above(fine, a)
        return counted[a]

    grain = max(1, (top << up) >> bits)
    out = []
    for k in range(wanted):  # the largest a with more than k roots above, to the grain
        low = max(a for a, c in counted.items() if c > k)
        high = min(a for a, c in counted.items() if c <= k)
        while high - low > grain:
            lone = above(low) - above(high) == 1
            if lone and high - low < (top << up) >> 12:
                low, high = newton(fine, low, high, grain)
                break
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) > k else (low, middle)
        out.append(Fraction(low + high, 2 << up))
    return out


def value(poly: list[int], a: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * a + c
    return total


def newton(poly: list[int], low: int, high: int, grain: int) -> tuple[int, int]:
    """Bracket no wider than ``grain`` of the only root in (low, high]: Newton steps, kept inside by the sign, else halves."""
    slope = [k * c for k, c in enumerate(poly)][1:]
    right = value(poly, high)
    if right == 0:
        return high, high
    at = (low + high) // 2
    while high - low > grain:
        v = value(poly, at)
        if v == 0:
            return at, at
        if (v > 0) == (right > 0):
            high = at
        else:
            low = at
        d = value(slope, at)
        step = at - v // d if d else (low + high) // 2
        # a step beside the root closes the bracket from both sides
        near = step - grain // 4 if step >= at else step + grain // 4
        for spot in (step + grain // 3, step - grain // 3):
            if low < spot < high:
                if (value(poly, spot) > 0) == (right > 0):
                    high = min(high, spot)
                else:
                    low = max(low, spot)
        at = near if low < near < high else (low + high) // 2
        if high - low <= 1:
            break
    return low, high


# -- components -----------------------------------------------------------------------------
def eliminate(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-pivoted triangular factors of a matrix, in place of it, and the row order; pivots of zero become tiny."""
    m, order = m.copy(), np.arange(len(m))
    tiny = np.finfo(m.dtype).eps * max(float(np.abs(m).max()), np.finfo(np.float64).tiny)
    for k in range(len(m)):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if p != k:
            m[[k, p]], order[[k, p]] = m[[p, k]], order[[p, k]]
        if abs(m[k, k]) < tiny:
            m[k, k] = tiny
        m[k + 1:, k] /= m[k, k]
        m[k + 1:, k + 1:] -= np.outer(m[k + 1:, k], m[k, k + 1:])
    return m, order


def solve(factors: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    m, order = factors
    x = b[order].copy()
    for k in range(1, len(m)):
        x[k] -= m[k, :k] @ x[:k]
    for k in range(len(m) - 1, -1, -1):
        x[k] = (x[k] - m[k, k + 1:] @ x[k + 1:]) / m[k, k]
    return x


def null_vectors(a: np.ndarray, values: list[Fraction], top: Fraction) -> np.ndarray:
    """Unit eigenvectors (rows) of the integer matrix for its roots, in extended precision."""
    dim, kind = len(a), np.longdouble
    scale = float(top)
    matrix = np.array([[kind(int(v)) / kind(scale) for v in row] for row in a], kind)
    found: list[np.ndarray] = []
    roots: list[float] = []
    for k, root in enumerate(values):
        exact = root / Fraction(scale)
        high = kind(float(exact))
        shift = high + kind(float(exact - Fraction(float(high))))
        factors = eliminate(matrix - shift * np.eye(dim, dtype=kind))
        close = [v for v, r in zip(found, roots) if abs(r - float(exact)) < 1e-6]
        x = np.random.default_rng(k).standard_normal(dim).astype(kind)
        for _ in range(4):
            for v in close + close:
                x = x - (v @ x) * v
            x = solve(factors, x / np.sqrt(x @ x))
            x = x / np.abs(x).max()
        for v in close + close:
            x = x - (v @ x) * v
        found.append(x / np.sqrt(x @ x))
        roots.append(float(exact))
    return np.array(found, kind).reshape(len(found), dim)


class Model:
    """What a fit leaves: counts, sums of ``x``, eigenvalues of the covariance and their unit vectors."""

    def __init__(self, n: int, first: list[int], values: list[float], shares: list[float], vectors: np.ndarray):
        self.n, self.values, self.shares = n, values, shares
        #: of x - SHIFT
        self.first = first
        self.vectors = vectors

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where that is enough, else Python integers."""
        y = x - SHIFT
        most = max(int(np.abs(y).max(initial=0)) * self.n, max(map(abs, self.first), default=0))
        kind = np.int64 if most < 1 << 61 else object
        return y.astype(kind) * self.n - np.array(self.first, kind)

    def deviations(self, c: np.ndarray) -> list[int | None]:
        """Sum of squares of each row, exact; None where a long cannot hold it."""
        if c.dtype != object and int(np.abs(c).max(initial=0)) ** 2 * c.shape[1] < 1 << 62:
            return (c * c).sum(axis=1).tolist()
        return [v if v <= LONG[1] else None for v in (sum(int(e) ** 2 for e in row) for row in c)]

    def whiten(self, c: np.ndarray) -> np.ndarray:
        projected = c.astype(np.longdouble) @ self.vectors.T.astype(np.longdouble)
        return (projected / np.longdouble(self.n) / np.sqrt(np.array(self.values, np.longdouble))).astype(np.float64)


def fit_model(spark: SparkSession, fit: DataFrame, dim: int, components: int = COMPONENTS) -> Model | None:
    """Components of the rows of ``fit`` (distinct ``x``); None without rows."""
    n, first, second = moments(fit, dim)
    if not n:
        return None
    a = scatter_matrix(n, first, second)
    factor = math.gcd(*(int(v) for v in a.ravel())) or 1
    a = np.array([[int(v) // factor for v in row] for row in a], object)
    trace = sum(int(a[i, i]) for i in range(dim))
    roots = rounded_roots(characteristic_polynomial(spark, a), components) if trace else []
    vectors = null_vectors(a, roots, roots[0]) if roots else np.zeros((0, dim), np.longdouble)
    return Model(n, first, [float(r * factor / n / n) for r in roots], [float(r / trace) for r in roots], vectors)


def identity_error(fit: DataFrame, model: Model, dim: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity; two passes, centred in the second."""
    k = len(model.values)
    mean = np.zeros(k)
    for centred in (False, True):
        def run(batches, mean=mean, centred=centred):
            total = np.zeros((k, k) if centred else k)
            for batch in batches:
                w = model.whiten(model.centred(matrix_of(batch["x"], dim))) - mean
                total = total + (w.T @ w if centred else w.sum(axis=0))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(total.size), pa.int32()), "value": pa.array(total.ravel(), pa.float64())})

        sums = fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(k * k if centred else k)
        for cell, v in sums:
            total[cell] = v
        if not centred:
            mean = total / model.n
    return float(np.abs(total.reshape(k, k) / model.n - np.eye(k)).max())


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Rows with a null vector, or with null or non-finite entries, are dropped, empty vectors too. The dimension is that of most rows (of
    equals the larger); vectors of another length are dropped. Components with eigenvalue zero are left out, so a table of equal
    vectors, or an empty one, gives no rows. Repeated rows each have their result; entries beyond 2^62 / 64 count as that bound.
    ``deviation`` is null where a long cannot hold it. ``components`` of at most a few hundred and dimensions up to about a thousand are
    meant: the polynomial costs dim^3 a prime, and about dim primes.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_rows(vectors)
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = cut_lineage(rows.select("x").distinct())
    model = fit_model(spark, fit, dim, components)
    if not model.values:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model, dim)
    k = len(model.values)

    def run(batches):
        for batch in batches:
            c = model.centred(matrix_of(batch["x"], dim))
            many = np.repeat(np.arange(len(c)), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch["vec_id"].take(pa.array(many)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(c))),
                "n": pa.array(np.full(len(many), model.n, np.int64)), "deviation": pa.array(model.deviations(c), pa.int64()).take(pa.array(many)),
                "whitened": pa.array(model.whiten(c).ravel()), "explained": pa.array(np.tile(model.shares, len(c))),
                "identity_error": pa.array(np.full(len(many), error))})

    return rows.mapInArrow(run, schema)
