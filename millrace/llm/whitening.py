"""Embedding whitening: principal components by MLlib's SVD of the centred rows, scaled to unit variance.

Entries are coded as whole numbers, so that counts, sums, deviations and the total variance are exact.
Sums per dimension come first; rows are then centred by them, n * x - S as a whole number, before
anything is multiplied. RowMatrix.computeSVD works on these rows where they lie and brings one matrix
of dims * dims to the driver; all components are asked for, since then it decomposes that matrix with
LAPACK rather than to ARPACK's tolerance. A singular value s becomes the variance s * s / n. The
total variance comes apart from these, from the exact deviations of all rows.

Nothing of a row's size travels but to its own task, so lost executors only repeat their share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
_DECIMAL = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of the rows it is fitted on: as large as dims * components, whatever the number of rows."""

    n: int
    sums: tuple[int, ...]  # of coded entries, per dimension
    components: np.ndarray  # dims * k, unit columns
    variances: np.ndarray  # k, falling
    total: float  # variance over all dimensions

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total


def valid(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite entries."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _usual_length(rows: DataFrame, vec_col: str) -> int:
    top = rows.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def _usable(vectors: DataFrame, vec_col: str, dims: int) -> DataFrame:
    return vectors.where(valid(F.col(vec_col)) & (F.size(vec_col) == dims))


def _coded(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of coded entries."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= 1 << 62:
        raise OverflowError("an entry is too large to be coded as a 64-bit number")
    return flat.astype(np.int64).reshape(-1, dims) + SHIFT


def _off(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly; by way of the whole part of the mean, and in unbounded numbers where 64 bits are too few."""
    x = x - np.array([s // n for s in sums], np.int64)
    if len(x) and int(np.abs(x).max()) * n >= 1 << 62:
        x = x.astype(object)
    return x * n - np.array([s % n for s in sums], np.int64)


def _deviations(off: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    if len(off) and (off.dtype == object or int(np.abs(off).max()) ** 2 * off.shape[1] >= 1 << 63):
        off = off.astype(object)
    return (off * off).sum(axis=1).tolist()


def _moments(rows: DataFrame, vec_col: str, dims: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for b in batches:
            n, total = n + b.num_rows, total + _coded(b.column(0), dims).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(total)], ["d", "n", "s"])

    parts = rows.select(vec_col).mapInArrow(run, "d long, n long, s long")
    per = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d").collect()
    return (per[0].n if per else 0), tuple(r.s for r in per)


def _total(rows: DataFrame, vec_col: str, n: int, sums: tuple[int, ...]) -> int:
    """Sum over all rows and dimensions of (n * x - S)^2, as a whole number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                total += sum(_deviations(_off(_coded(part.column(0), len(sums)), n, sums)))
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total)], _DECIMAL)], ["t"])

    return int(rows.select(vec_col).mapInArrow(run, "t decimal(38,0)").agg(F.sum("t")).first()[0])


def _centred(rows: DataFrame, vec_col: str, n: int, sums: tuple[int, ...]) -> DataFrame:
    """(v): each row less the mean, as an MLlib vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                c = (_off(_coded(part.column(0), len(sums)), n, sums) / n).astype(np.float64)
                cuts = np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), pa.array(c.ravel()))], ["v"])

    vectors = rows.select(vec_col).mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("v"))
    return MLUtils.convertVectorColumnsFromML(vectors, "v")


def fit(vectors: DataFrame, vec_col: str = "embedding", top: int = 32, least: float = 1e-5, dims: int | None = None) -> Whitening | None:
    """The `top` strongest components of all usable rows: valid ones of `dims` entries (the most frequent length; of equally frequent ones the greatest). None if rows don't differ in any dimension.

    Components whose standard deviation is below `least` of the strongest one's are noise of the
    arithmetic and are left out, so fewer than `top` come back where dims or the rank is smaller.
    """
    dims = _usual_length(vectors.where(valid(F.col(vec_col))), vec_col) if dims is None else dims
    if not dims:
        return None
    rows = _usable(vectors, vec_col, dims)
    n, sums = _moments(rows, vec_col, dims)
    total = _total(rows, vec_col, n, sums) if n else 0
    if not total:
        return None
    found = RowMatrix(_centred(rows, vec_col, n, sums), n, dims).computeSVD(dims, computeU=False, rCond=least)
    k = min(top, len(found.s))
    variances = found.s.toArray()[:k] ** 2 / n
    return Whitening(n, sums, found.V.toArray()[:, :k].copy(), variances, float(Decimal(total) / Decimal(n) ** 3))


_ADDED = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


def transform(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> DataFrame:
    """Usable rows with deviation (sum over dimensions of (n * x - S)^2) and whitened (an entry per component).

    Columns of these two names are replaced, the others stay, and so do repeated rows and rows without
    an id. A model may be used on rows it wasn't fitted on.
    """
    base = _usable(vectors, vec_col, len(model.sums)).select(*[c for c in vectors.columns if c not in _ADDED.names])
    at, k = base.columns.index(vec_col), len(model.variances)
    n, sums = model.n, model.sums
    towards = model.components / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                off = _off(_coded(part.column(at), len(sums)), n, sums)
                far = pa.array(list(map(Decimal, _deviations(off))), _DECIMAL)
                w = (off / n).astype(np.float64) @ towards
                cuts = np.arange(0, w.size + 1, k, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, far, pa.ListArray.from_arrays(pa.array(cuts), pa.array(w.ravel()))], [*part.schema.names, *_ADDED.names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *_ADDED.fields]))


def identity_error(whitened: DataFrame, col: str = "whitened") -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n) less the identity; 0 for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                w = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                n, s, g = n + len(w), s + w.sum(axis=0), g + w.T @ w
        if n:
            cells = np.concatenate([[n], s, g.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

    parts = whitened.select(col).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    if not parts:
        return 0.0
    cells = np.array([r.v for r in parts])
    k = next(i for i in range(len(cells)) if i * i + i + 1 == len(cells))
    mean = cells[1 : k + 1] / cells[0]
    cov = cells[k + 1 :].reshape(k, k) / cells[0] - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 32) -> DataFrame:
    """A row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    An empty table, or one whose usable rows are all equal, has no components and no rows.
    """
    model = fit(vectors, vec_col, top)
    if model is None:
        return vectors.select(F.col(id_col).cast("long").alias("vec_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).limit(0)
    rows = transform(vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec_col), model, vec_col)
    error = identity_error(rows)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    long = rows.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("p", "whitened"))
    return long.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("p") + 1).alias("explained"), F.lit(error).alias("identity_error"))
