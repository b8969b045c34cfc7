"""Whitening of embeddings by a tall-skinny QR decomposition.

Components become integers, ``floor(scale * c) + shift``, so that sums are exact.
The fit list holds each distinct integer vector once. Every partition of it centres
its rows with the exact sums and folds them into one triangular factor R, at most
``ROWS`` rows at a time; factors are merged ``FAN`` at a time, round by round, each
round a table in the shared folder. The last R, as wide and as high as a vector,
goes to the driver; its right singular vectors are the components. No covariance
is formed to find them. How far the whitened fit list's covariance is from the
identity is measured in one more pass: each partition centres before it multiplies,
and the partitions' products are put together by their means.

Defined results: rows whose vector is null or empty, holds null or non-finite
components, components of 2^40 or more, or is of another length than most take no
part; rows without an id and repeated rows stay, each with its own result. Equal
vectors are one entry of the fit list. Components whose singular value is below
``least`` of the largest are left out, as their direction is rounding error, so
that a fit list of one vector, or of vectors with fewer dimensions, gives fewer
components. Equal eigenvalues: any orthonormal choice, the same for all rows. A
``deviation`` beyond a long is null. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROWS, FAN = 4096, 16
#: Components of this magnitude or more take no part.
LARGEST = float(1 << 40)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, scale: int, shift: int = 0, largest: float = LARGEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, ``keep``, x): the rows that take part, x being floor(scale * component) + shift as longs."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.col("embedding").cast("array<double>").alias("c"))
    # Not a number compares as larger than any number, so that this leaves it out as well.
    v = v.where(F.expr("size(c) > 0") & ~F.exists("c", lambda x: x.isNull() | (F.abs(x) >= largest)))
    sizes = v.groupBy(F.size("c").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    v = v.where(F.size("c") == (sizes[0].n if sizes else 0))
    return v.select("vec_id", *keep, F.transform("c", lambda x: F.floor(x * F.lit(float(scale))) + F.lit(shift).cast("long")).alias("x"))


def matrix(column) -> np.ndarray:
    """A column of lists of one length, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square factor R of the QR decomposition of ``rows``, filled up with zeros."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


@dataclass
class Centre:
    """Exact sums of ``n`` integer vectors; ``span`` bounds the magnitude of their entries."""

    n: int
    sums: list[int]
    span: int

    @classmethod
    def of(cls, fit: DataFrame) -> Centre:
        """Of the vectors x of ``fit``, one at least."""

        def summed(batches):
            for batch in batches:
                x = matrix(batch.column(0))
                if len(x):
                    rows = [(k, int(total), int(most)) for k, (total, most) in enumerate(zip(x.sum(0), np.abs(x).max(0), strict=True))]
                    rows.append((-1, len(x), 0))
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["dim", "total", "most"])

        parts = fit.select("x").mapInArrow(summed, "dim int, total long, most long")
        rows = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most")).orderBy("dim").collect()  # one row a dimension
        return cls(int(rows[0].total), [int(r.total) for r in rows[1:]], max(int(r.most) for r in rows[1:]))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        kind = np.int64 if self.n * self.span < 1 << 61 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum of squares of each row of ``scaled``; null beyond a long."""
        y = self.scaled(x)
        rough = (y.astype(np.float64) ** 2).sum(1)
        fits = rough < 9.2e18
        if y.dtype == object:
            return pa.array([int((row * row).sum()) if ok else None for row, ok in zip(y, fits, strict=True)], pa.int64())
        y[~fits] = 0
        return pa.array((y * y).sum(1), pa.int64(), mask=~fits)


def r_factor(fit: DataFrame, centre: Centre | None = None) -> np.ndarray:
    """The factor R of all vectors x of ``fit`` (one at least), centred if ``centre`` is given."""

    def folded(batches):
        r = None
        for batch in batches:
            x = matrix(batch.column(0))
            rows = centre.centred(x) if centre else x.astype(np.float64)
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                r = triangle(part if r is None else np.vstack([r, part]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merged(key, table):
        order = np.argsort(table.column("part").to_numpy())
        each = [np.frombuffer(r) for r in table.column("r").to_pylist()]
        wide = round(len(each[0]) ** 0.5)
        r = triangle(np.vstack([each[i].reshape(wide, wide) for i in order]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = stored(fit.select("x").mapInArrow(folded, "part long, r binary"), "factors")
    while factors.limit(2).count() > 1:
        factors = stored(factors.groupBy(F.expr(f"part div {FAN}").alias("into")).applyInArrow(merged, "part long, r binary"), "factors")
    r = np.frombuffer(factors.first()["r"])
    wide = round(len(r) ** 0.5)
    return r.reshape(wide, wide)


@dataclass
class Whitener:
    """The centre, the columns that whiten centred rows, and each component's share of the variance."""

    centre: Centre
    columns: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, fit: DataFrame, components: int, least: float) -> Whitener:
        """From the distinct vectors x of ``fit``."""
        centre = Centre.of(fit)
        _, s, right = np.linalg.svd(r_factor(fit, centre))
        kept = (s > s[0] * least)[:components] if s[0] > 0 else np.zeros(0, bool)
        k = int(kept.sum())
        return cls(centre, (right[:k].T / s[:k]) * np.sqrt(centre.n), s[:k] ** 2 / (s**2).sum() if k else s[:0])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components)"""
        return self.centre.centred(x) @ self.columns


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""

    def products(batches):
        for batch in batches:
            w = model.whitened(matrix(batch.column(0)))
            if not len(w):
                continue
            mean = w.mean(0)
            own = (w - mean).T @ (w - mean)
            i, j = np.triu_indices(len(mean))
            columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[i, j]), pa.array(mean[i] * len(w)), pa.array(mean[j] * len(w)), pa.array(mean[i] * mean[j] * len(w))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "own", "left", "right", "between"])

    parts = fit.select("x").mapInArrow(products, "i int, j int, own double, left double, right double, between double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("own", "left", "right", "between")])
    n = float(model.centre.n)
    entry = (F.col("own") + F.col("between") - F.col("left") * F.col("right") / n) / n
    worst = sums.agg(F.max(F.abs(entry - (F.col("i") == F.col("j")).cast("double"))).alias("worst")).first()
    return float(worst["worst"] or 0.0)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, least: float = 1e-10) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part and every component, ``components`` at most."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, scale, shift), "vectors")
    fit = stored(rows.select("x").distinct(), "fit")
    if not fit.limit(1).count():
        return spark.createDataFrame([], RESULT)
    model = Whitener.fit(fit, components, least)
    k = len(model.explained)
    error = identity_error(fit, model) if k else 0.0

    def run(batches):
        for batch in batches:
            x, m = matrix(batch.column(1)), batch.num_rows
            if not m or not k:
                continue
            each = np.repeat(np.arange(m), k)
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)), model.centre.deviation(x).take(pa.array(each))]
            columns += [pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)
