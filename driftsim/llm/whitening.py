"""Whitening of embeddings by the covariance of their distinct integer vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftsim.session import durable

#: Steps of a unit, and components that are kept.
STEPS, COMPONENTS = 256, 4
#: A covariance is width * width numbers at the driver; longer vectors are refused.
WIDEST = 4096
#: Vectors multiplied at once hold so many numbers.
BLOCK = 1 << 18


def usable(column: str = "embedding") -> Column:
    """The vector and all its entries are there and finite, and their steps fit a long."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * STEPS) < float(1 << 63))
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, entry), F.lit(False))


def integer_vector(column: str = "embedding") -> Column:
    return F.transform(column, lambda c: F.floor(c.cast("double") * STEPS).cast("long"))


def _keys(x: str) -> list[Column]:
    """128 bits that stand for a vector in the join back."""
    return [F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(1), F.col(x)).alias("k2")]


def _blocks(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, BLOCK // width)
    for lo in range(0, batch.num_rows, step):
        rows = slice(lo, min(lo + step, batch.num_rows))
        yield rows, batch.column(column).slice(lo, rows.stop - lo).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - (whole + rest); the difference of the whole numbers is taken first, where it fits."""
    if x.dtype == np.int64 and int(max(abs(int(x.min())), abs(int(x.max())))) >= 1 << 62:
        return x.astype(np.float64) - whole - rest
    return (x - whole).astype(np.float64) - rest


def weighted_sums(distinct: DataFrame, column: str, width: int) -> list[int]:
    """Per dimension the exact sum of weight * x, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            for rows, x in _blocks(batch, column, width):
                weight = batch.column("weight").to_numpy()[rows]
                if int(max(abs(int(x.min())), abs(int(x.max())))) * int(weight.sum()) < 1 << 62:
                    total += (weight @ x).astype(object)
                else:
                    total += weight.astype(object) @ x.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "part"])

    rows = distinct.select("weight", column).mapInArrow(run, "i int, part decimal(38,0)").groupBy("i").agg(F.sum("part").alias("total")).collect()
    total = [0] * width
    for r in rows:
        total[r["i"]] = int(r["total"])
    return total


def centred_covariance(distinct: DataFrame, column: str, width: int, whole: np.ndarray, rest: np.ndarray, weights: int) -> np.ndarray:
    """Sum of weight * (x - m)(x - m)^T over ``weights``, where m = whole + rest is the mean.

    Each task multiplies its centred vectors block by block and returns one matrix, row by
    row; rows of equal number meet and are summed before the width * width result is drawn.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for rows, x in _blocks(batch, column, width):
                centred = _centred(x, whole, rest)
                total += (centred * batch.column("weight").to_numpy()[rows][:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("i").to_pylist(), batch.column("part"), strict=True):
                row = part.values.to_numpy()
                total[i] = total[i] + row if i in total else row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "part"]
        )

    form = "i int, part array<double>"
    found = distinct.select("weight", column).mapInArrow(products, form).repartition("i").mapInArrow(summed, form)
    out = np.zeros((width, width))
    for r in found.collect():
        out[r["i"]] = r["part"]
    return (out + out.T) / (2 * weights)


@dataclass
class Fit:
    """``n`` and ``sums`` of the fit list; the kept components with their variances."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: list[float | None]


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    n = distinct.agg(F.sum("weight")).first()[0]
    sums = weighted_sums(distinct, "x", width)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    covariance = centred_covariance(distinct, "x", width, whole, rest, n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k, trace = min(components, width), float(np.trace(covariance))
    values = np.where(values > max(values[0], 0) * width * np.finfo(float).eps, values, 0.0)
    return Fit(n, sums, vectors[:, :k].copy(), values[:k].copy(), [float(v) / trace if trace > 0 else None for v in values[:k]])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per row the exact sum of (n * x - S) ** 2."""
    top = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums))
    if top < 1 << 31 and top * top * x.shape[1] < 1 << 63:
        off = x * n - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", off, off).tolist()
    off = x.astype(object) * n - np.array(sums, object)
    return [int(v) for v in (off * off).sum(axis=1)]


def _whitened(distinct: DataFrame, width: int, found: Fit) -> DataFrame:
    """(k1, k2, weight, deviation, whitened) of every distinct vector, written."""
    n, sums = found.n, found.sums
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    known = found.variances > 0
    scaled = found.vectors[:, known] / np.sqrt(found.variances[known])
    k, limit = len(known), 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _blocks(batch, "x", width):
                part = batch.slice(rows.start, len(x))
                value = np.full((len(x), k), np.nan)
                value[:, known] = _centred(x, whole, rest) @ scaled
                flat = pa.array(value.ravel(), pa.float64(), from_pandas=True)
                offsets = pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32))
                off = pa.array([Decimal(v) if v < limit else None for v in deviations(x, n, sums)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), part.column("weight"), off, pa.ListArray.from_arrays(offsets, flat)],
                    ["k1", "k2", "weight", "deviation", "whitened"],
                )

    return durable(distinct.select("k1", "k2", "weight", "x").mapInArrow(run, "k1 long, k2 long, weight long, deviation decimal(38,0), whitened array<double>"))


def identity_error(whitened: DataFrame, found: Fit) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    known = np.flatnonzero(found.variances > 0)
    if not len(known):
        return None
    some = whitened.select("weight", F.array(*[F.col("whitened")[int(c)] for c in known]).alias("whitened"))
    means = some.agg(*[F.sum(F.col("weight") * F.col("whitened")[c]) / found.n for c in range(len(known))]).first()
    rest = np.array(means, np.float64)
    off = centred_covariance(some, "whitened", len(known), np.zeros(len(known)), rest, found.n) - np.eye(len(known))
    return float(np.abs(off).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, by_count: bool = False) -> DataFrame:
    """Whiten every usable row of ``vectors`` (``column``: array of numbers, ...).

    Returns (document, n, deviation, whitened, explained, identity_error): ``document`` is
    the input row as a struct, so columns of any name pass through. An entry c becomes
    x = floor(STEPS * c). Equal x vectors are one: it is fitted with weight one, or with
    its count if ``by_count``, whitened once and joined back to its rows. ``n`` is the sum
    of the weights and S that of weight * x; ``deviation`` is the sum over dimensions of
    (n * x - S) ** 2, exact, null beyond 38 digits. The covariance is centred by the exact
    mean before multiplying and divided by n. ``whitened`` has the projections of x - S/n
    on the first ``components`` unit eigenvectors (fewer if the vector is shorter) over
    the square roots of their eigenvalues, ``explained`` the eigenvalues' shares in the
    trace; ``identity_error`` is the largest entry of the whitened covariance minus the
    identity.

    Rows whose vector is null, empty, or holds a null, non-finite or too large entry (256 c
    beyond a long) are dropped. Vectors of each length are a fit of their own; over WIDEST
    entries raise an error, for a covariance is drawn to the driver. A component without
    variance gives null ``whitened`` and takes no part in ``identity_error``; without any
    variance ``explained`` is null too. Tied eigenvalues have any basis of their space,
    the same for all rows. Repeated rows come back each; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    good = vectors.filter(usable(column) & (F.size(column) > 0))
    rows = good.select(integer_vector(column).alias("x"))
    distinct = rows.groupBy("x").agg(F.count("*").alias("times"))
    weight = F.col("times") if by_count else F.lit(1).cast("long")
    distinct = durable(distinct.select(*_keys("x"), weight.alias("weight"), F.size("x").alias("width"), "x"))
    widths = sorted(r["width"] for r in distinct.groupBy("width").agg(F.count("*")).collect())
    if widths and widths[-1] > WIDEST:
        raise ValueError(f"vectors of {widths[-1]} entries, more than {WIDEST}")
    figures = "k1 long, k2 long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    fitted = spark.createDataFrame([], figures)
    for width in widths:
        own = distinct.filter(F.col("width") == width)
        found = fit(own, width, components)
        table = _whitened(own, width, found)
        error = identity_error(table, found)
        fitted = fitted.unionByName(
            table.select(
                "k1", "k2", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                F.array(*[F.lit(e).cast("double") for e in found.explained]).alias("explained"),
                F.lit(error).cast("double").alias("identity_error"),
            )
        )
    if len(widths) != 1:
        fitted = durable(fitted)
    keyed = good.select(F.struct("*").alias("document"), integer_vector(column).alias("x")).select("document", *_keys("x"))
    return keyed.join(fitted, ["k1", "k2"]).drop("k1", "k2")
