"""Embedding whitening: exact distributed covariance, float32 eigenvectors, mixed-precision refinement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from strandline.storage import staging_path

SHIFT = 1_000_000
_LIMIT = 1 << 52  # a finite entry beyond this many steps counts as this many
_LIMB, _ROWS = 20, 4096  # products of 20-bit limbs over 4,096 rows are exact in a double
_WIDEST = 10**38  # what decimal(38, 0) holds


def _steps(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable (``dim`` finite entries), and floor(64 * entry) + SHIFT of those."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    flat = column.filter(ok).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is nan
    v = flat.reshape(-1, dim)
    finite = np.isfinite(v).all(axis=1)
    usable = ok.to_numpy(zero_copy_only=False).copy()
    usable[usable] = finite
    return usable, np.clip(np.floor(64.0 * v[finite]), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT


def _packed(x: np.ndarray) -> list[bytes]:
    """Equal vectors give equal bytes: 4 bytes an entry where all fit, else 8."""
    small = (np.abs(x) < 1 << 31).all(axis=1)
    return [(r.astype(np.int32) if s else r).tobytes() for r, s in zip(x, small)]


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    rows = [np.frombuffer(b, np.int32 if len(b) == 4 * dim else np.int64) for b in column.to_pylist()]
    return np.array(rows, np.int64).reshape(-1, dim)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers without rounding, as Python integers: products of limbs of 20 bits in doubles."""
    total = np.zeros((y.shape[1],) * 2, object)
    for lo in range(0, len(y), _ROWS):
        rest, limbs = y[lo : lo + _ROWS], []
        while rest.any():
            limb = ((rest + (1 << (_LIMB - 1))) & ((1 << _LIMB) - 1)) - (1 << (_LIMB - 1))  # signed digits
            limbs.append(limb.astype(np.float64))
            rest = (rest - limb) >> _LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return total


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    high, low = (x >> 26).sum(axis=0).astype(object), (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
    return (high << 26) + low


def _decimals(values) -> pa.Array:
    return pa.array([str(v) for v in values], pa.string()).cast(pa.decimal128(38, 0))


def _sums(dim: int):
    """Task function: packed vectors to (i, total, n), a row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for b in batches:
            x = _unpacked(b.column("x"), dim)
            n, total = n + len(x), total + _exact_sums(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), _decimals(total), pa.array([n] * dim, pa.int64())], names=["i", "total", "n"])

    return run


def _cells(dim: int, centre: np.ndarray):
    """Task function: packed vectors to (i, j, total), the upper triangle of the Gram matrix about ``centre``."""
    i, j = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for b in batches:
            total = total + exact_gram(_unpacked(b.column("x"), dim) - centre)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(total[i, j])], names=["i", "j", "total"])

    return run


def _wide(values: np.ndarray) -> np.ndarray:
    """Integers as the widest floats there are, each as a double and what it leaves."""
    high = values.astype(np.float64)
    low = np.array([int(v) - int(h) for v, h in zip(values.ravel(), high.ravel())], object).reshape(values.shape).astype(np.float64)
    return high.astype(np.longdouble) + low.astype(np.longdouble)


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the symmetric ``a`` from approximate vectors ``x``, by matrix products.

    Each round measures R = I - x'x and S = x'ax in extended precision and corrects x by x @ E, where
    E[i, j] = (S[i, j] + w[j] * R[i, j]) / (w[j] - w[i]) for eigenvalues further apart than the error of the
    round, and R[i, j] / 2 for the others.  The corrections shrink quadratically for separated eigenvalues.  Those
    that stay closer than the error form clusters: a small eigenproblem of (a - mu * I), restricted to the span of
    a cluster's vectors and scaled by the cluster's own width, turns them apart before the next round.
    """
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    eye, size = np.eye(len(a), dtype=np.longdouble), np.sqrt((a * a).sum())
    best = np.inf
    for at in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2
        w = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        error = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = w[None, :] - w[:, None]
        apart = np.abs(gap) > error
        e = np.where(apart, (s + w[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(-w, kind="stable")
        x, w = x[:, order], w[order]
        change = float(np.abs(e).max())
        if at == rounds - 1 or change < 1e-18 or (change < 1e-14 and change >= best):
            break
        best = change
        starts = np.flatnonzero(np.concatenate([[True], w[:-1] - w[1:] > error]))
        for lo, hi in zip(starts, [*starts[1:], len(w)]):
            if hi - lo > 1:
                part, mu = x[:, lo:hi], (w[lo] + w[hi - 1]) / 2
                t = part.T @ (a @ part) - mu * (part.T @ part)
                width = np.abs(t).max()
                if width > 0:
                    turn = np.linalg.eigh(((t + t.T) / 2 / width).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
                    # the turn's own rounding is taken out by the r / 2 term of the next round
                    x[:, lo:hi] = part @ turn
    w = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-w, kind="stable")
    x = x[:, order]
    return w[order], x / np.sqrt((x * x).sum(axis=0))


@dataclass
class Whitener:
    """Mean (as ``centre + offset / n``), unit eigenvectors as columns and eigenvalues of one covariance."""

    n: int
    centre: np.ndarray
    offset: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is not lost in the rounding of the largest."""
        return self.values > len(self.centre) * np.finfo(np.float64).eps * max(float(self.values[0]), 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of vectors; nan for a component without variance."""
        centred = (x - self.centre).astype(np.float64) - self.offset.astype(np.float64) / self.n
        scale = np.sqrt(np.where(self.usable(), self.values, np.nan))
        return (centred @ self.vectors) / scale


def fit(vectors: DataFrame, dim: int, components: int) -> Whitener | None:
    """Eigenvectors of the covariance of a table of distinct packed vectors ``x``; None of an empty one.

    The vectors are moved to the whole number below their mean before they are multiplied, and all sums are integers,
    so the covariance is exact up to one last rounding, on any cluster layout.  What reaches the driver is the matrix: dim * (dim + 1) / 2 sums.
    """
    first = vectors.mapInArrow(_sums(dim), "i int, total decimal(38,0), n long").groupBy("i").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect()
    if not first:
        return None
    n, total = first[0]["n"], np.zeros(dim, object)
    for r in first:
        total[r["i"]] = int(r["total"])
    centre = total // n
    offset = total - centre * n
    centre = centre.astype(np.int64)
    cells = vectors.mapInArrow(_cells(dim, centre), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    gram = np.zeros((dim, dim), object)
    for r in cells.collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = int(r["total"])
    wide = _wide(gram * n - np.outer(offset, offset)) / np.longdouble(n) / np.longdouble(n)
    size = np.abs(wide).max() or np.longdouble(1)
    start = np.linalg.eigh((wide / size).astype(np.float32))[1]
    values, found = refine(wide / size, start)
    k = min(components, dim)
    return Whitener(n, centre, offset, found[:, :k].astype(np.float64), (values[:k] * size).astype(np.float64), float(np.trace(wide)))


def _spread(model: Whitener, dim: int):
    """Task function: packed vectors to sums of the whitened components and of their products."""
    k = len(model.values)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = np.nan_to_num(model.project(_unpacked(b.column("x"), dim)))
            total, cross = total + w.sum(axis=0), cross + w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array([*i, *range(k)], pa.int32()), pa.array([*j, *[-1] * k], pa.int32()), pa.array([*cross[i, j], *total], pa.float64())], names=["i", "j", "total"]
        )

    return run


def identity_error(vectors: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    dim, ok = len(model.centre), model.usable()
    if not ok.any():
        return None
    rows = vectors.mapInArrow(_spread(model, dim), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    at = {(r["i"], r["j"]): r["total"] / model.n for r in rows}
    use = np.flatnonzero(ok)
    # the components are centred to begin with, so what their mean takes off is of the order of its rounding
    return float(max(abs(at[i, j] - at[i, -1] * at[j, -1] - (i == j)) for i in use for j in use if i <= j))


def _components(model: Whitener, dim: int, error: float | None):
    """Task function: (id, vector) rows to a row for each vector and component."""
    k, n = len(model.values), model.n
    explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                ok, x = _steps(b.column("vector"), dim)
                y = x - model.centre
                if len(y) and float(np.abs(y).max() + 1) ** 2 * dim * float(n) ** 2 < 2.0**62:
                    deviation = ((n * y - model.offset.astype(np.int64)) ** 2).sum(axis=1)
                else:
                    deviation = ((y.astype(object) * n - model.offset) ** 2).sum(axis=1)
                ids = b.column("id").filter(pa.array(ok))
                each = np.repeat(np.arange(len(y)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(each), n)),
                        pa.array([None if v >= _WIDEST else str(v) for v in deviation], pa.string()).cast(pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(model.project(x).ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(explained, len(y)), pa.float64(), from_pandas=True),
                        pa.array([error] * len(each), pa.float64()),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


_RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", *, components: int = 16) -> DataFrame:
    """A row for each usable vector and component: the id, component, n, deviation, whitened, explained, identity_error.

    An entry c is taken as the whole number floor(64 * c) + 1,000,000.  The covariance (divisor n) is over the distinct
    vectors, so copies, however many, weigh once.  Components are numbered from 1 by falling eigenvalue.  ``deviation``
    is the exact sum of squares of n * x - S; it is null where it has more than 38 digits.

    Left out: null vectors, vectors with null or non-finite entries, empty ones, and those whose length isn't the most frequent
    one (ties: the longest).  Entries beyond 2**52 steps count as that.  Null, repeated or tied ids are rows like others.  A component without
    variance has a null ``whitened``; without any variance ``explained`` and ``identity_error`` are null too.  Equal eigenvalues share a
    subspace, of which some basis is given, the same for all rows.  An empty table gives no rows.  Other columns are not looked at.

    The matrix of dim * dim entries is solved on the driver; everything that grows with the rows is done by Spark.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    lengths = base.groupBy(F.size("vector").alias("length")).count().where("length > 0").orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    schema = StructType([StructField("id", base.schema["id"].dataType), *_parse_datatype_string(_RESULT).fields])
    if not lengths:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    dim = lengths[0]["length"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_packed(_steps(b.column("vector"), dim)[1]), pa.binary())], names=["x"])

    path = staging_path(spark, "vectors")
    base.select("vector").mapInArrow(pack, "x binary").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    model = fit(distinct, dim, components)
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    return base.mapInArrow(_components(model, dim, identity_error(distinct, model)), schema).withColumnRenamed("id", id_column)
