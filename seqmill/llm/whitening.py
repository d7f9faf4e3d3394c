"""Operator 11: whitening of vectors with covariances recovered by polarisation.

Vectors become whole numbers.  For every dimension i and every sum of two dimensions
i + j the squares of the centred values are added up exactly; the covariance of i and
j is then half of what the sum's variance exceeds the two variances by.  Sums of
squares are all that leaves a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import common_width, finite, scaled, ship, written

#: Scaled entries are held at this: sums over any table then stay within decimal(38).
MOST = 1 << 40
#: Up to this size, centred entries are squared and added up in 64 bits, a block of rows at a time.
_NARROW = 1 << 20
_BLOCK = 4096


@dataclass(frozen=True)
class Whole:
    """Vectors as whole numbers ``x = floor(scale * c) + shift``."""
    width: int
    scale: int = 1024
    shift: int = 100_000

    def of(self, column: pa.Array) -> np.ndarray:
        return scaled(column, self.width, self.scale, MOST) + self.shift


@dataclass(frozen=True)
class Spectrum:
    """What is known of the fit list: exact sums, and the leading eigenvectors as columns of ``axes``."""
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def sums(vectors: DataFrame, whole: Whole, vector: str) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""
    def run(batches):
        n, total = 0, [0] * whole.width
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                x = whole.of(b.column(0).slice(at, _BLOCK))
                n += len(x)
                total = [t + int(s) for t, s in zip(total, x.sum(0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, whole.width), pa.int32()), _decimals([n, *total])],
                                             names=["i", "s"])

    part = vectors.select(vector).mapInArrow(run, "i int, s decimal(38,0)")
    got = {r.i: int(r.s) for r in part.groupBy("i").agg(F.sum("s").alias("s")).collect()}  # one row a dimension
    return got.get(-1, 0), [got.get(i, 0) for i in range(whole.width)]


def _squares(d: np.ndarray):
    """Sums of squares of the columns i (as i, i) and of the sums of columns i and j (i < j), row by row of i."""
    d = np.ascontiguousarray(d.T)
    if np.abs(d).max(initial=0) > _NARROW:
        d = d.astype(object)
    for i in range(len(d)):
        s = d[i] + d[i + 1:]
        yield np.concatenate([(d[i:i + 1] * d[i:i + 1]).sum(1), (s * s).sum(1)])


def squared_sums(vectors: DataFrame, whole: Whole, n: int, total: list[int], vector: str) -> dict[tuple[int, int], int]:
    """``{(i, j): sum of (n*u - U)^2}``, exact, u being x_i for i = j and x_i + x_j for i < j, U the sum of u.

    A task centres by the mean rounded down, d = u - floor(U / n), a small whole number.
    As n*u - U = n*d - r with r = sum of d, the sum of its squares is n^2 * sum of d^2 - n * r^2.
    """
    floor = np.array([t // n for t in total], np.int64)

    def run(batches):
        held = None
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                d = whole.of(b.column(0).slice(at, _BLOCK)) - floor
                new = [q.astype(object) for q in _squares(d)]
                held = new if held is None else [h + q for h, q in zip(held, new)]
        if held is not None:
            for i, q in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(q), pa.int32()), pa.array(range(i, whole.width), pa.int32()),
                                                  _decimals(q)], names=["i", "j", "q"])

    part = vectors.select(vector).mapInArrow(run, "i int, j int, q decimal(38,0)")
    table = part.groupBy("i", "j").agg(F.sum("q").alias("q")).toArrow()  # one row a pair of dimensions
    rest = [t - n * int(f) for t, f in zip(total, floor)]
    out = {}
    for i, j, q in zip(*(table.column(c).to_pylist() for c in ("i", "j", "q"))):
        r = rest[i] if i == j else rest[i] + rest[j]
        out[i, j] = n * n * int(q) - n * r * r
    return out


def spectrum(n: int, total: list[int], squares: dict[tuple[int, int], int], components: int) -> Spectrum:
    """Eigenvectors of the covariance by falling eigenvalue, signed so that the largest entry is positive."""
    d = len(total)
    cov = np.zeros((d, d))
    for (i, j), q in squares.items():
        # whole numbers up to here; the quotient of two is rounded once
        cov[i, j] = cov[j, i] = q / n ** 3 if i == j else (q - squares[i, i] - squares[j, j]) / (2 * n ** 3)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    big = np.abs(axes).argmax(0) if axes.size else np.zeros(0, int)
    axes = axes * np.where(axes[big, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Spectrum(n, total, values, axes, float(np.trace(cov)))


def projected(vectors: DataFrame, whole: Whole, sp: Spectrum, key: str, vector: str) -> DataFrame:
    """``key, deviation, w``: exact deviation and whitened values (null where the eigenvalue is none) of each vector."""
    n = sp.n
    floor = np.array([t // n for t in sp.sums], np.int64)
    rest = np.array([t % n for t in sp.sums], object)
    share = np.array([r / n for r in rest], float)
    known = sp.values > np.finfo(float).eps * max(1, whole.width) * max(sp.values.max(initial=0), 0)
    scale = np.where(known, 1 / np.sqrt(np.where(known, sp.values, 1)), np.nan)
    kind = vectors.schema[key].dataType.simpleString()
    rest_squared = int((rest * rest).sum())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                c = b.slice(at, _BLOCK)
                d = whole.of(c.column(1)) - floor
                w = (d - share) @ sp.axes * scale
                most = int(np.abs(d).max(initial=0))
                e = d if most <= _NARROW else d.astype(object)
                square = (e * e).sum(1)
                # n * most * width bounds the sum of rest times entry
                cross = (e * rest.astype(np.int64)).sum(1) if n * most * whole.width < 1 << 62 else (d.astype(object) * rest).sum(1)
                dev = [n * n * int(a) - 2 * n * int(x) + rest_squared for a, x in zip(square, cross)]
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([c.column(0), _decimals(dev), lists], names=[key, "deviation", "w"])

    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, deviation decimal(38,0), w array<double>")


def identity_error(wide: DataFrame, components: list[int]) -> float | None:
    """Largest absolute entry of the covariance of the whitened values, as they are, minus the identity."""
    if not components:
        return None
    means = wide.agg(*[F.avg(F.col("w")[k]).alias(f"m{k}") for k in components]).first()
    c = {k: F.col("w")[k] - F.lit(means[f"m{k}"]) for k in components}
    pairs = [(a, b) for a in components for b in components if a <= b]
    cov = wide.agg(*[F.avg(c[a] * c[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(cov[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(rows: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding",
           scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    An entry c counts as ``floor(scale * c) + shift``; ``n`` vectors make the fit list.  ``deviation``
    (decimal, exact) is the sum over the dimensions of (n * x - S)^2, S the dimension's sum.
    ``whitened`` is x - S / n on the component, over the root of its eigenvalue; ``explained`` the
    eigenvalue's share of the trace.  ``identity_error`` is measured on the whitened values themselves.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, as are
    vectors of another length than most have.  Scaled entries beyond 2^40 are held there.
    Fewer dimensions than ``components`` give as many components.  Where an eigenvalue is zero to double precision
    (equal vectors, fewer vectors than components) ``whitened`` is null and the component is
    not in ``identity_error``.  Equal eigenvalues have one of their bases, the same for all rows.
    Repeated rows and repeated or null keys count each.  An empty table gives no rows; other
    columns are left out.
    """
    ship(rows.sparkSession)
    vectors = finite(rows.select(key, vector), vector)
    width = common_width(vectors, vector)
    vectors = vectors.where(F.size(vector) == width) if width else vectors.where("false")
    whole = Whole(width, scale, shift)
    n, total = sums(vectors, whole, vector) if width else (0, [])
    sp = spectrum(n, total, squared_sums(vectors, whole, n, total, vector) if n else {}, components)
    wide = written(projected(vectors, whole, sp, key, vector), "whitened") if n else \
        projected(vectors, whole, Spectrum(1, [0] * width, np.zeros(0), np.zeros((width, 0)), 0.0), key, vector)
    known = [k for k, v in enumerate(sp.values) if v > np.finfo(float).eps * max(1, width) * sp.values[0]]
    error = identity_error(wide, known) if n else None
    explained = [max(float(v), 0.0) / sp.trace if sp.trace > 0 else None for v in sp.values]
    out = wide.select(key, "deviation", F.posexplode("w").alias("k", "whitened"))
    shares = F.array(*[F.lit(x).cast("double") for x in explained]) if explained else F.array().cast("array<double>")
    return out.select(key, (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
