"""Whitened embeddings from an eigendecomposition that grows by rank-one updates.

Entries become integers (``floor(1024 c) + 100000``), so counts, sums and deviations are exact.

1. Every partition keeps the spectrum of the scatter about its own mean.  A row is one centred
   rank-one update: with q the eigenvectors and z the row's difference from the mean in their
   coordinates, the new eigenvalues are the roots of the secular equation
   ``1 / rho + sum z_j^2 / (d_j - x) = 0``, one between each two old ones.  Coordinates that are
   (nearly) zero and eigenvalues that are (nearly) equal are deflated first.  The new vectors
   come from the z that the computed roots belong to exactly, which keeps them orthogonal.
2. Spectra are combined in groups of ``FAN``, level by level: each eigenvector of one side is a
   rank-one update of the other, and one more joins the means.
3. A distributed pass projects the exactly centred rows on the vectors found; the small
   projected covariance is solved for the final vectors and values (Rayleigh-Ritz).
4. Another pass measures the covariance of the whitened rows against the identity.

A row costs a task some products of d x d numbers, a partition leaves d x d numbers, and the
driver receives d x d sums: nothing else grows with the rows.

Defined cases: vectors that are null, hold null or non-finite entries or entries whose integer
does not fit 62 bits, or have another length than most take no part; rows that repeat count
each; a null id stays; components whose share of the variance is below 1e-12 are left out (all
of them if every row is equal); no row gives no row.  A deviation beyond 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.common import cut_lineage

SCALE, SHIFT = 1024.0, 100_000
#: Spectra that are combined in one group; components that are returned; least share of the variance.
FAN, COMPONENTS, LEAST = 16, 8, 1e-12
EPS = np.finfo(np.float64).eps


# --- the spectrum of a growing matrix --------------------------------------------------


@lru_cache(maxsize=64)
def _lower(n: int) -> np.ndarray:
    """1 where row <= column: the poles at or below each root."""
    return np.triu(np.ones((n, n)))


@lru_cache(maxsize=64)
def _partners(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For pole j and root i the other pole that the root is paired with, and whether there is one."""
    j, i = np.indices((n, n))
    return np.where(i < j, i, np.minimum(i + 1, n - 1)), (i < j) | (i < n - 1)


def secular_roots(d: np.ndarray, w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1/rho + sum w_j / (d_j - x), for ascending d, and the matrix d_j - root_i.

    A root is kept as its distance from the nearer pole, so that the differences are exact to
    the last digits however close they are.  Steps fit one simple pole on each side of the
    root; a bracket that only shrinks catches the steps that leave it.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + rho * w.sum())
    half = (upper - d) / 2
    middle = 1.0 / rho + (w[:, None] / (d[:, None] - (d + half)[None, :])).sum(axis=0)
    left = middle >= 0
    left[-1] = True
    base = np.where(left, d, upper)
    low, high = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    if middle[-1] < 0:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    poles, above = d[:, None] - base[None, :], upper - base
    root = np.where(left & (low == 0), high, low)
    root[-1] = half[-1]
    sought, below, near = np.arange(n), _lower(n), np.arange(n)  # the roots still sought
    for _ in range(100):
        delta = poles[:, sought] - root[sought]
        terms = w[:, None] / delta
        value = 1.0 / rho + terms.sum(axis=0)
        far = np.abs(value) > EPS * n * (1.0 / rho + np.abs(terms).sum(axis=0))
        if not far.all():
            sought, delta, terms, value = sought[far], delta[:, far], terms[:, far], value[far]
            if not len(sought):
                break
        slopes = terms / delta
        low[sought], high[sought] = np.where(value < 0, root[sought], low[sought]), np.where(value < 0, high[sought], root[sought])
        d1, d2 = delta[sought, near[: len(sought)]], above[sought] - root[sought]
        first = (slopes * below[:, sought]).sum(axis=0)
        second = slopes.sum(axis=0) - first
        with np.errstate(all="ignore"):
            a = (d1 + d2) * value - d1 * d2 * (first + second)
            b, c = d1 * d2 * value, value - d1 * first - d2 * second
            inner = np.sqrt(np.maximum(0.0, a * a - 4 * b * c))
            step = root[sought] + np.where(a <= 0, (a - inner) / (2 * c), 2 * b / (a + inner))
        inside = (step > low[sought]) & (step < high[sought])
        step = np.where(inside, step, (low[sought] + high[sought]) / 2)
        moved = step != root[sought]
        root[sought] = step
        sought = sought[moved]
        if not len(sought):
            break
    return base + root, poles - root


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of q diag(d) q' + rho v v', from ascending ``d`` and for ``rho`` > 0."""
    z = q.T @ v
    norm = float(np.sqrt(z @ z))
    tolerance = 8 * EPS * max(float(np.abs(d).max()), rho * norm * norm)
    if rho * norm * norm <= 0.0:
        return d, q
    live = np.flatnonzero(rho * np.abs(z) * norm > tolerance)
    if len(live) > 1 and (np.diff(d[live]) <= 2 * tolerance).any():
        # Neighbours with (nearly) one value: turn them so that only one of them meets v.
        d, q, kept, at = d.copy(), q.copy(), [], live[0]
        for j in live[1:]:
            r = np.hypot(z[at], z[j])
            c, s = z[j] / r, z[at] / r
            if (d[j] - d[at]) * abs(c * s) <= tolerance:
                q[:, at], q[:, j] = c * q[:, at] - s * q[:, j], s * q[:, at] + c * q[:, j]
                d[at], d[j] = d[at] * c * c + d[j] * s * s, d[at] * s * s + d[j] * c * c
                z[at], z[j] = 0.0, r
            else:
                kept.append(at)
            at = j
        live = np.array([*kept, at])
    n = len(live)
    if n == 0:
        return d, q
    old, part = d[live], z[live]
    roots, delta = secular_roots(old, part * part, rho)
    # The vector whose secular equation has exactly these roots.
    partner, paired = _partners(n)
    pairs = np.where(paired, old[partner] - old[:, None], 1.0)
    exact = np.sqrt(np.abs(np.prod(-delta / pairs, axis=1)))
    turned = np.copysign(exact, part)[:, None] / delta
    turned /= np.sqrt((turned * turned).sum(axis=0))
    d, q = d.copy(), q.copy()
    d[live], q[:, live] = roots, q[:, live] @ turned
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of the rows seen."""

    def __init__(self, dim: int):
        self.n, self.mean, self.d, self.q = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, row: np.ndarray) -> None:
        difference = row - self.mean
        if self.n:
            self.d, self.q = rank_one(self.d, self.q, difference, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + difference / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n or not self.n:
            if other.n:
                self.n, self.mean, self.d, self.q = other.n, other.mean, other.d, other.q
            return
        for value, vector in zip(other.d, other.q.T):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector, float(value))
        n = self.n + other.n
        difference = other.mean - self.mean
        self.d, self.q = rank_one(self.d, self.q, difference, self.n * other.n / n)
        self.mean, self.n = self.mean + difference * (other.n / n), n

    SCHEMA = "part bigint, n bigint, mean binary, d binary, q binary"

    def pack(self, part: int) -> pa.Table:
        parts = {name: [np.ascontiguousarray(getattr(self, name)).tobytes()] for name in ("mean", "d", "q")}
        return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([self.n], pa.int64()), **parts})

    @classmethod
    def unpack(cls, row: dict) -> Spectrum:
        d = np.frombuffer(row["d"])
        out = cls(len(d))
        out.n, out.mean, out.d = row["n"], np.frombuffer(row["mean"]), d
        out.q = np.frombuffer(row["q"]).reshape(len(d), len(d))
        return out


# --- Spark ----------------------------------------------------------------------------


def usable(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part and their length."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v"))

    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) >= float(1 << 52))

    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)), common["n"] if common else 0


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            yield batch, np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim) + SHIFT


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension."""

    def run(batches):
        n, total = 0, [0] * dim
        for _, x in _matrices(batches, dim):
            n += len(x)
            # Two halves, so that a batch of any integers adds up without overflow.
            high, low = (x >> 20).sum(axis=0), (x & ((1 << 20) - 1)).sum(axis=0)
            total = [t + (int(h) << 20) + int(lo) for t, h, lo in zip(total, high, low)]
        yield pa.record_batch(
            [pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(t) for t in (n, *total)], pa.decimal128(38, 0))], ["at", "total"])

    found = rows.select("v").mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()
    by = {r["at"]: int(r["total"]) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dim)]


def spectrum(rows: DataFrame, dim: int) -> Spectrum:
    """The combined spectrum of all partitions."""

    def fit(batches):
        from pyspark import TaskContext

        own = Spectrum(dim)
        for _, x in _matrices(batches, dim):
            for row in x.astype(np.float64):
                own.add(row)
        if own.n:
            yield from own.pack(TaskContext.get().partitionId()).to_batches()

    def combine(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        out = Spectrum.unpack(parts[0])
        for other in parts[1:]:
            out.merge(Spectrum.unpack(other))
        return out.pack(parts[0]["part"] // FAN)

    parts = cut_lineage(rows.select("v").mapInArrow(fit, Spectrum.SCHEMA))
    left = parts.agg(F.max("part")).first()[0]
    if left is None:
        return Spectrum(dim)
    while left > 0:
        parts = cut_lineage(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(combine, Spectrum.SCHEMA))
        left //= FAN
    return Spectrum.unpack(parts.first().asDict())


def centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n x - S as integers (of Python where 64 bits do not hold them), and divided by n."""
    if n * int(np.abs(x).max()) + max(map(abs, total)) < 1 << 62:
        exact = x * n - np.array(total, dtype=np.int64)
    else:
        exact = x.astype(object) * n - np.array(total, dtype=object)
    return exact, exact.astype(np.float64) / n


def products(rows: DataFrame, dim: int, n: int, total: list[int], basis: np.ndarray) -> np.ndarray:
    """Mean products of the centred rows in the given coordinates, a constant 1 among them, over all rows."""
    width = basis.shape[1] + 1
    one, two = np.tril_indices(width)

    def run(batches):
        held = np.zeros((width, width))
        for _, x in _matrices(batches, dim):
            y = centred(x, n, total)[1] @ basis
            y = np.column_stack([y, np.ones(len(y))])
            held += y.T @ y
        yield pa.record_batch([pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(held[one, two])], ["i", "j", "p"])

    found = rows.select("v").mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    out = np.zeros((width, width))
    for r in found:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["p"] / n
    return out


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    spark: SparkSession = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    rows, dim = usable(vectors, id_column, column)
    n, total = sums(rows, dim) if dim else (0, [])
    if not n:
        return spark.createDataFrame([], schema)
    basis = np.linalg.qr(spectrum(rows, dim).q)[0]
    values, turn = np.linalg.eigh(products(rows, dim, n, total, basis)[:-1, :-1])
    trace = float(values.sum())
    axes, values = (basis @ turn)[:, ::-1][:, :components], values[::-1][:components]
    told = values > LEAST * trace
    axes, values = axes[:, told] / np.sqrt(values[told]), values[told]
    if not len(values):
        return spark.createDataFrame([], schema)
    moments = products(rows, dim, n, total, axes)
    covariance = moments[:-1, :-1] - np.outer(moments[-1, :-1], moments[-1, :-1])
    error = float(np.abs(covariance - np.eye(len(values))).max())
    explained = values / trace
    limit = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, dim):
            exact, real = centred(x, n, total)
            if exact.dtype == object or dim * int(np.abs(exact).max()) ** 2 >= 1 << 63:
                exact = exact.astype(object)
            deviation = [Decimal(int(t)) if t < limit else None for t in (exact * exact).sum(axis=1)]
            k, m = len(values), len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch([
                batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.decimal128(38, 0)).take(each), pa.array((real @ axes).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ], names)

    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(run, schema)
