"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become integers, so sums and products over any number of rows are exact: tasks add up integer products, and
the scatter n·Σxxᵀ − ΣxΣxᵀ (n² times the covariance) is known to the last digit. Its characteristic polynomial is
computed modulo many primes, one task for some primes each: elimination to Hessenberg form, then the recurrence of
its leading minors. Chinese remaindering joins the residues. As all roots are real, sign changes after a Taylor
shift count the roots above a point exactly; bisection on such counts isolates the eigenvalues and refines them far
beyond double precision. Each component then follows by inverse iteration on the null space of scatter − eigenvalue
in decimal arithmetic. What the driver holds depends on the number of entries of a vector, never on the rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import comb, isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, ship

SCALE = 64  # a constant added to all scaled entries would change no deviation, so none is added
LARGEST = 1 << 40  # scaled entries beyond this count as this
COMPONENTS = 32
BITS = 80  # of an eigenvalue
DIGITS = 90  # of the decimals in inverse iteration
LIMB = 20  # bits of a limb, so that sums of products of limbs stay exact in doubles


class Whitening(NamedTuple):
    """Vectors of ``size`` entries: row count, exact sums of the unshifted integers, and per component the eigenvalue
    of the scatter, the share of the trace and the unit vector (columns of ``vectors``)."""

    size: int
    n: int
    sums: list[int]
    eigenvalues: list[Fraction]
    explained: list[float]
    vectors: np.ndarray
    identity_error: float = 0.0


# ---- exact sums in tasks ------------------------------------------------------------------------

def integer_rows(vectors: pa.Array, size: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of usable vectors and floor(64·entry) of their entries, by the number of entries."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    out = []
    for k in np.unique(sizes[sizes > 0]) if size is None else [size]:
        places = np.flatnonzero(sizes == k)
        rows = values[offsets[places][:, None] + np.arange(k)]
        good = np.isfinite(rows).all(1)
        with np.errstate(over="ignore"):  # what overflows is beyond LARGEST anyway
            scaled = np.clip(np.floor(rows[good] * SCALE), -LARGEST, LARGEST)
        out.append((places[good], scaled.astype(np.int64)))
    return out


def exact_products(rows: np.ndarray) -> np.ndarray:
    """The matrix of Σ x_i·x_j as Python integers: limbs are multiplied as doubles in runs whose sums stay exact."""
    size = rows.shape[1]
    total = np.zeros((size, size), dtype=object)
    largest = int(np.abs(rows).max(initial=0))
    if largest < 1 << LIMB:
        limbs = [rows]
    else:
        limbs, left = [], rows
        while int(np.abs(left).max()) >= 1 << LIMB:
            limbs.append(left & ((1 << LIMB) - 1))
            left = left >> LIMB
        limbs.append(left)
        largest = 1 << LIMB
    run = max(1, (1 << 53) // max(1, largest * largest))
    for at in range(0, len(rows), run):
        parts = [p[at:at + run].astype(np.float64) for p in limbs]
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)) if i + j else (a.T @ b).astype(np.int64).astype(object)
    return total


def _sums(df: DataFrame, vector: str) -> DataFrame:
    """(size, i, j, value): exact sums over all rows; i = -1 counts the rows, j = -1 sums an entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for _, rows in integer_rows(batch.column(0)):
                if len(rows):
                    total = totals.setdefault(rows.shape[1], [0, 0, 0])
                    total[0] += len(rows)
                    total[1] = total[1] + rows.sum(0).astype(object)
                    total[2] = total[2] + exact_products(rows)
        for size, (n, sums, products) in totals.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(1 + size + len(i), size, dtype=np.int32)), pa.array([-1, *range(size), *i.tolist()], pa.int32()),
                pa.array([-1, *[-1] * size, *j.tolist()], pa.int32()),
                pa.array([Decimal(int(v)) for v in [n, *sums, *products[i, j]]], pa.decimal128(38, 0))], names=["size", "i", "j", "value"])

    bound_batches(df.sparkSession)
    parts = df.select(F.col(f"`{vector}`").cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(
        run, "size int, i int, j int, value decimal(38,0)")
    return parts.groupBy("size", "i", "j").agg(F.sum("value").alias("value"))


# ---- the characteristic polynomial ----------------------------------------------------------------

def primes_below(start: int) -> Iterator[int]:
    """Primes downwards from ``start`` (below 2³²), by strong tests to bases that suffice there."""
    for p in range(start - 1 | 1, 2, -2):
        d, s = p - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for base in (2, 7, 61):
            x = pow(base, d, p)
            if x in (1, p - 1):
                continue
            for _ in range(s - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                break
        else:
            yield p


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo ``p`` with zeros below the first subdiagonal."""
    h, size = matrix.copy(), len(matrix)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[at, k + 1]] = h[[k + 1, at]]
            h[:, [at, k + 1]] = h[:, [k + 1, at]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(1)) % p
    return h


def polynomial(h: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo ``p`` of det(x − h), the constant first, from the leading minors of a Hessenberg matrix."""
    size = len(h)
    minors = np.zeros((size + 1, size + 1), dtype=np.int64)
    minors[0, 0] = 1
    for m in range(size):
        new = -h[m, m] * minors[m] % p
        new[1:] += minors[m, :-1]
        if m:
            run, weights = 1, np.zeros(m, dtype=np.int64)
            for r in range(m - 1, -1, -1):
                run = run * int(h[r + 1, r]) % p
                weights[r] = int(h[r, m]) * run % p
            new -= (weights[:, None] * minors[:m] % p).sum(0) % p
        minors[m + 1] = new % p
    return minors[size]


def common_degree(f: np.ndarray, p: int) -> int:
    """Degree of the greatest common divisor of ``f`` and its derivative modulo ``p``."""
    strip = lambda x: x[:int(np.flatnonzero(x)[-1]) + 1] if x.any() else x[:0]
    a, b = strip(f % p), strip(f[1:] * np.arange(1, len(f)) % p)
    while len(b):
        inverse = pow(int(b[-1]), -1, p)
        a = a.copy()
        while len(a) >= len(b):
            a[len(a) - len(b):] = (a[len(a) - len(b):] - int(a[-1]) * inverse % p * b) % p
            a = strip(a)
        a, b = b, a
    return len(a) - 1


def characteristic(spark: SparkSession, matrix: np.ndarray) -> tuple[list[int], int]:
    """Coefficients of det(x − matrix), the constant first, and the number of different roots.

    ``matrix`` holds Python integers and has no negative eigenvalue, so the k-th coefficient from the top is at most
    C(d, k)·(trace/d)^k. Enough primes are taken for twice the largest bound. Primes are rows of a small table.
    """
    size = len(matrix)
    trace = sum(int(matrix[i, i]) for i in range(size))
    bound = max(comb(size, k) * (-(-trace // size)) ** k for k in range(size + 1))
    primes, product = [], 1
    for p in primes_below(1 << 31):
        if product > 4 * bound and len(primes) >= 3:
            break
        primes.append(p)
        product *= p
    entries = [[int(v) for v in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                f = polynomial(hessenberg(np.array([[v % p for v in row] for row in entries], dtype=np.int64), p), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([f.tolist()], pa.list_(pa.int64())), pa.array([common_degree(f, p)], pa.int32())],
                                                 names=["p", "f", "shared"])

    slices = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(slices).mapInArrow(run, "p long, f array<long>, shared int").collect()
    out = [0] * (size + 1)
    for r in rows:
        rest = product // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        out = [a + unit * c for a, c in zip(out, r["f"])]
    out = [c % product for c in out]
    return [c - product if c > product // 2 else c for c in out], size - min(r["shared"] for r in rows)


# ---- roots ------------------------------------------------------------------------------------

def roots_above(f: list[int], at: int, bits: int) -> int:
    """How many roots of ``f`` lie above ``at`` / 2^bits, each as often as it occurs; all roots of ``f`` are real.

    For such a polynomial the sign changes of f(x + at) are exactly the number of its positive roots.
    """
    degree = len(f) - 1
    g = [c << (bits * (degree - k)) for k, c in enumerate(f)]
    for i in range(degree):
        for k in range(degree - 1, i - 1, -1):
            g[k] += at * g[k + 1]
    signs = [c > 0 for c in g if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_sign(f: list[int], at: int, bits: int) -> int:
    """Sign of f(at / 2^bits)."""
    v, degree = 0, len(f) - 1
    for k in range(degree, -1, -1):
        v = v * at + (f[k] << (bits * (degree - k)))
    return (v > 0) - (v < 0)


def real_roots(f: list[int], different: int, wanted: int) -> list[tuple[Fraction, int]]:
    """The largest ``wanted`` positive roots (or more, of equal ones) with multiplicity, falling, to ``BITS`` bits.

    ``f`` has no root below 0 and none that isn't real; ``different`` counts its different roots.
    """
    zeros = next(i for i, c in enumerate(f) if c)
    f, different = f[zeros:], different - (zeros > 0)
    if not different:
        return []
    top = max(1, abs(f[-2])).bit_length() + 1  # all roots are at most their sum
    # half-open intervals (low, high] at 2^-bits with the number of roots above both ends
    open_, done = [(0, 1 << top, 0, len(f) - 1, 0)], []
    while len(open_) + len(done) < different:
        open_.sort(key=lambda x: Fraction(x[1] - x[0], 1 << x[2]))
        low, high, bits, above_low, above_high = open_.pop()
        if high - low == 1:
            low, high, bits = low << 8, high << 8, bits + 8
        middle = (low + high) // 2
        above = roots_above(f, middle, bits)
        for part in ((low, middle, bits, above_low, above), (middle, high, bits, above, above_high)):
            if part[3] > part[4]:
                (done if part[3] - part[4] == 1 else open_).append(part)
    out, count = [], 0
    for low, high, bits, above_low, above_high in sorted([*open_, *done], key=lambda x: x[4]):
        if count >= wanted:
            break
        many = above_low - above_high
        right = (-1) ** (above_high % 2)  # the sign between this root and the next larger one
        while low != high and ((high - low) << BITS) > low:
            if high - low == 1:
                low, high, bits = low << 16, high << 16, bits + 16
            middle = (low + high) // 2
            if many > 1:
                low, high = (middle, high) if roots_above(f, middle, bits) == above_low else (low, middle)
                continue
            sign = value_sign(f, middle, bits)
            if sign == 0:
                low = high = middle
            elif sign == right:
                high = middle
            else:
                low = middle
        out.append((Fraction(low + high, 2 << bits), many))
        count += many
    return out


# ---- components -----------------------------------------------------------------------------------

def null_vectors(matrix: list[list[int]], root: Fraction, many: int) -> np.ndarray:
    """``many`` unit vectors that matrix − root sends to 0, as rows: inverse iteration in decimals of ``DIGITS`` digits.

    The triangular factors are made once. Vectors of an eigenvalue that occurs several times are kept orthogonal.
    The entry of largest size (the first of equal ones) is positive.
    """
    context = decimal.Context(prec=DIGITS + len(str(max(1, max(abs(v) for row in matrix for v in row)))))
    with decimal.localcontext(context):
        size = len(matrix)
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        for i in range(size):
            a[i, i] -= shift
        tiny = max((abs(v) for v in a.ravel()), default=Decimal(1)) * Decimal(10) ** -(DIGITS - 10) or Decimal(1)
        order = np.arange(size)
        for k in range(size):
            at = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
            if at != k:
                a[[at, k]], order[[at, k]] = a[[k, at]], order[[k, at]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < size:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - np.outer(a[k + 1:, k], a[k, k + 1:])
        found: list[np.ndarray] = []
        draw = np.random.default_rng(7)
        for _ in range(many):
            v = np.array([Decimal(int(x)) for x in draw.integers(1, 1000, size)], dtype=object)
            for _ in range(12):
                before, v = v, v[order]
                for k in range(1, size):
                    v[k] = v[k] - (a[k, :k] * v[:k]).sum()
                for k in range(size - 1, -1, -1):
                    v[k] = (v[k] - ((a[k, k + 1:] * v[k + 1:]).sum() if k + 1 < size else 0)) / a[k, k]
                v = v / max(abs(x) for x in v)  # before any product, as entries may be huge
                for _ in range(2):
                    for u in found:
                        v = v - u * (u * v).sum()
                v = v / (v * v).sum().sqrt()
                if v[max(range(size), key=lambda i: abs(v[i]))] < 0:
                    v = -v
                if max(abs(x) for x in v - before) < Decimal(10) ** -30:
                    break
            found.append(v)
        return np.array([[float(x) for x in v] for v in found])


def components_of(spark: SparkSession, matrix: np.ndarray, roots: list[tuple[Fraction, int]]) -> list[np.ndarray]:
    """The unit vectors of each root, a task for some roots each."""
    entries = [[int(v) for v in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, over, under, many in zip(*(c.to_pylist() for c in batch.columns)):
                found = null_vectors(entries, Fraction(int(over), int(under)), many)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], names=["number", "v"])

    rows = [(i, str(r.numerator), str(r.denominator), m) for i, (r, m) in enumerate(roots)]
    slices = min(len(rows), spark.sparkContext.defaultParallelism)
    got = spark.createDataFrame(rows, "number long, over string, under string, many int").repartition(slices).mapInArrow(run, "number long, v array<double>").collect()
    by_number = {r["number"]: np.array(r["v"]).reshape(-1, len(entries)) for r in got}
    return [by_number[i] for i in range(len(rows))]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors of ``df``: exact sums, then at most ``components`` components.

    Null vectors and those with null or non-finite entries are left out; of vectors of different length the most
    frequent length counts (of equally frequent ones the larger). Components of eigenvalue 0 don't exist, so constant,
    single or no vectors give none. The data are read twice: for the sums, and for the covariance of what comes out.
    """
    spark = df.sparkSession
    sums = _sums(df, vector).collect()  # pairs of entries, times the different lengths
    counts = {r["size"]: int(r["value"]) for r in sums if r["i"] == -1}
    if not counts:
        return Whitening(0, 0, [], [], [], np.zeros((0, 0)))
    size = max(counts, key=lambda s: (counts[s], s))
    n, total, scatter = counts[size], [0] * size, np.zeros((size, size), dtype=object)
    for r in sums:
        if r["size"] == size and r["i"] >= 0 and r["j"] < 0:
            total[r["i"]] = int(r["value"])
    for r in sums:
        if r["size"] == size and r["j"] >= 0:
            i, j = r["i"], r["j"]
            scatter[i, j] = scatter[j, i] = n * int(r["value"]) - total[i] * total[j]
    trace = sum(scatter[i, i] for i in range(size))
    if not trace:
        return Whitening(size, n, total, [], [], np.zeros((size, 0)))
    roots = real_roots(*characteristic(spark, scatter), components)
    vectors = components_of(spark, scatter, roots)
    eigenvalues = [r for r, m in roots for _ in range(m)][:components]
    model = Whitening(size, n, total, eigenvalues, [float(r / trace) for r in eigenvalues], np.concatenate(vectors)[:components].T)
    return model._replace(identity_error=_identity_error(df, vector, model))


def _centred(rows: np.ndarray, model: Whitening) -> np.ndarray:
    """n·x − S as exact integers; Python integers where 64 bits might not do."""
    largest = model.n * int(np.abs(rows).max(initial=0)) + max((abs(s) for s in model.sums), default=0)
    if largest < 1 << 62:
        return rows * model.n - np.array(model.sums, dtype=np.int64)
    return rows.astype(object) * model.n - np.array(model.sums, dtype=object)


def _project(centred: np.ndarray, model: Whitening) -> np.ndarray:
    """Unrounded deviations on the components, over the square roots of the covariance's eigenvalues."""
    places = 1 << 120
    spread = [isqrt(int(e * places)) / (1 << 60) / model.n for e in model.eigenvalues]  # √e of the covariance, e/n²
    return ((centred / model.n).astype(np.float64) @ model.vectors) / np.array(spread)


def _plain(model: Whitening) -> tuple:
    return model.size, model.n, model.sums, [str(e) for e in model.eigenvalues], model.explained, model.vectors, model.identity_error


def _identity_error(df: DataFrame, vector: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    if not model.eigenvalues:
        return 0.0
    plain = _plain(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _from_plain(plain)
        k = len(own.eigenvalues)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, rows in integer_rows(batch.column(0), own.size):
                w = _project(_centred(rows, own), own)
                sums += w.sum(0)
                products += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([
            pa.array([*range(k), *i.tolist()], pa.int32()), pa.array([*[-1] * k, *j.tolist()], pa.int32()), pa.array([*sums, *products[i, j]], pa.float64())],
            names=["i", "j", "value"])

    bound_batches(df.sparkSession)
    cells = df.select(F.col(f"`{vector}`").cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(
        run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # pairs of components
    mean = {r["i"]: r["value"] / model.n for r in cells if r["j"] < 0}
    return max(abs(r["value"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in cells if r["j"] >= 0)


def _from_plain(plain: tuple) -> Whitening:
    return Whitening(*plain[:3], [Fraction(e) for e in plain[3]], *plain[4:])


def whiten(df: DataFrame, model: Whitening, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``ident``, deviation, whitened) of every row that the fit counted, in the order of the components.

    ``deviation`` is Σ(n·x − S)² as decimal(38,0), null beyond it; ``whitened`` an ``array<double>``, empty without
    components. Null and repeated ids are rows like others; an empty table gives none; other columns are ignored.
    """
    source = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where("vector is not null")
    plain = _plain(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _from_plain(plain)
        for batch in batches:
            for places, rows in integer_rows(batch.column("vector"), own.size) if own.size else []:
                centred = _centred(rows, own)
                if centred.dtype == object or float(np.abs(centred).max(initial=0)) ** 2 * own.size >= 1 << 62:
                    squares = [int(s) for s in (centred.astype(object) ** 2).sum(1)]
                    deviation = pa.array([Decimal(s) if s < 10 ** 38 else None for s in squares], pa.decimal128(38, 0))
                else:
                    deviation = pa.array((centred * centred).sum(1)).cast(pa.decimal128(38, 0))
                w = _project(centred, own)
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(places)), deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                                                 names=["id", "deviation", "whitened"])

    bound_batches(df.sparkSession)
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", ident)


ship(__name__)
