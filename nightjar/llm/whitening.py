"""Whitening of embeddings by polarisation.

The covariance of two dimensions follows from three variances: ``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2``. So one
aggregate of squares, exact in whole numbers, over every dimension and every sum of two dimensions gives the whole
covariance matrix. Its size depends on the dimensions alone; it is assembled on the driver and decomposed there, while
vectors stay in tasks.

Entries are turned into whole numbers ``x = floor(64 c) + 1000000`` (fixed values). They are centred on the whole number
nearest to their mean before they are squared; what is left of the mean, less than a half, is taken off in exact
integer arithmetic afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from nightjar.llm.common import written

SCALE, SHIFT = 64, 1_000_000  # fixed values of the contract
COMPONENTS = 16
SAFE = 1 << 20  # deviations below it are squared and added in 64-bit integers, others in integers of any size
ROWS = 8_192  # vectors handled at a time inside a task


def fixed_point(vector: Column) -> Column:
    """Whole numbers of a vector's entries."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite entries."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


@dataclass
class Fit:
    """What the fit list says about vectors of one length: its size, sums, axes and their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray  # one unit eigenvector per column, by falling eigenvalue
    values: np.ndarray
    trace: float
    mean: np.ndarray | None = None
    identity_error: float | None = None

    @property
    def centres(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rests(self) -> list[int]:
        return [s - self.n * int(c) for s, c in zip(self.sums, self.centres, strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of centred rows over the axes' standard deviations; not a number on axes without variance."""
        off = (x - self.centres).astype(np.float64) - np.array([r / self.n for r in self.rests])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (off @ self.axes) / np.sqrt(self.values), np.nan)


def blocks_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal vector length with their matrix of whole numbers, at most ``ROWS`` at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lengths = np.asarray(pc.list_value_length(part.column(column)))
            for dims in np.unique(lengths):
                own = part.filter(pa.array(lengths == dims))
                yield own, np.asarray(own.column(column).flatten(), dtype=np.int64).reshape(-1, int(dims))


def exact_squares(y: np.ndarray) -> list[int]:
    """Sum of squares of each single column (i, i) and of each sum of two columns (i, j), in the order of ``pairs``."""
    if len(y) and int(np.abs(y).max()) >= SAFE:
        y = y.astype(object)
    out: list[int] = []
    for i in range(y.shape[1]):
        out.append(int((y[:, i] * y[:, i]).sum()))
        both = y[:, i:i + 1] + y[:, i + 1:]
        out.extend(int(v) for v in (both * both).sum(axis=0))
    return out


def pairs(dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(dims)


def per_length(fits: dict[int, Fit], values, schema: str, rows: DataFrame) -> DataFrame:
    """Sums over all rows, by vector length and place, of the numbers that ``values(fit, x)`` lists for a block of rows.

    Each task adds up its own blocks first, so that it sends one row per length and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for _, x in blocks_of(batches, "x"):
            new = values(fits.get(x.shape[1]), x)
            old = held.get(x.shape[1])
            held[x.shape[1]] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
        for dims, sums in held.items():
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array([dims] * len(sums), pa.int32()), "place": pa.array(range(len(sums)), pa.int32()),
                "total": pa.array([str(s) for s in sums]) if schema == "string" else pa.array(sums, pa.float64())})

    parts = rows.mapInArrow(run, f"dims int, place int, total {schema}")
    total = F.sum(F.col("total").cast("decimal(38,0)")) if schema == "string" else F.sum("total")
    return parts.groupBy("dims", "place").agg(total.alias("total"))


def gathered(table: DataFrame) -> dict[int, list]:
    """Totals by length, in the order of their places; as many as the lengths and pairs of dimensions, whatever the rows."""
    out: dict[int, list] = {}
    for r in table.orderBy("dims", "place").collect():
        out.setdefault(r["dims"], []).append(r["total"])
    return out


def fit_list(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct vector of whole numbers once, as ``x``; empty vectors take no part."""
    values = embeddings.where(usable(F.col(vector)) & (F.size(vector) > 0)).select(fixed_point(F.col(vector)).alias("x"))
    return values.distinct()


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """Covariance matrix, divisor n, from exact sums of squares of centred values and of their pairwise sums."""
    rest = Fit(n, sums, np.empty((0, 0)), np.empty(0), 0.0).rests
    dims = len(sums)
    spread = np.empty((dims, dims), dtype=object)
    for i, j, square in zip(*pairs(dims), squares, strict=True):
        off = rest[i] + rest[j] if i != j else rest[i]
        spread[i, j] = n * int(square) - off * off  # n * n times a variance, exactly
    out = np.empty((dims, dims))
    for i in range(dims):
        out[i, i] = spread[i, i] / (n * n)
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n * n)
    return out


def principal(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading unit eigenvectors and eigenvalues; an eigenvalue below the rounding of the largest counts as zero."""
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    noise = max(float(values[0]), 0.0) * len(matrix) * np.finfo(float).eps
    return axes * np.where(signs == 0, 1, signs), np.where(values > noise, values, 0.0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Whitening of every vector length in a fit list ``(x)``, which is read four times: give a written table."""
    sizes = {r["dims"]: r["n"] for r in rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    add_up = lambda _, x: [int(v) for v in x.astype(object).sum(axis=0)]
    fits = {d: Fit(sizes[d], [int(v) for v in s], np.empty((0, 0)), np.empty(0), 0.0) for d, s in gathered(per_length({}, add_up, "string", rows)).items()}
    squares = gathered(per_length(fits, lambda f, x: exact_squares(x - f.centres), "string", rows))
    for dims, own in fits.items():
        matrix = covariance(own.n, own.sums, squares[dims])
        own.axes, own.values = principal(matrix, components)
        own.trace = float(np.trace(matrix))
    # how far the whitened fit list is from unit covariance, centred on its own mean before multiplying
    means = gathered(per_length(fits, lambda f, x: [float(v) for v in f.whitened(x).sum(axis=0)], "double", rows))
    for dims, own in fits.items():
        own.mean = np.array(means[dims]) / own.n

    def products(f: Fit, x: np.ndarray) -> list[float]:
        w = f.whitened(x) - f.mean
        return [float(v) for v in (w.T @ w)[pairs(w.shape[1])]]

    for dims, total in gathered(per_length(fits, products, "double", rows)).items():
        own, (i, j) = fits[dims], pairs(len(fits[dims].values))
        off = np.abs(np.array(total) / own.n - (i == j))
        own.identity_error = float(np.nanmax(off)) if not np.isnan(off).all() else 0.0
    return fits


def deviations(own: Fit, x: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of ``(n x - S)^2`` per row, exactly; null where it doesn't fit a long."""
    y, rest = x - own.centres, own.rests
    bound = own.n * (int(np.abs(y).max()) + 1) if len(y) else 0
    if bound * bound * x.shape[1] < 1 << 62:
        z = own.n * y - np.array(rest, dtype=np.int64)
        return (z * z).sum(axis=1).tolist()
    z = own.n * y.astype(object) - np.array(rest, dtype=object)
    return [int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` per usable row and component.

    Rows whose vector is null or holds a null or non-finite entry go, and so do empty vectors, which have no component.
    The fit list holds each distinct vector of whole numbers once, so copies weigh nothing more. Repeated rows and null
    keys are rows like any other. Vectors of unlike length are fitted apart. There are as many components as dimensions,
    ``components`` at most; on an axis without variance ``whitened`` is null. ``deviation`` is null where it is too large
    for a long. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    fits = fit(written(fit_list(embeddings, vector), "fit"), components)
    rows = embeddings.where(usable(F.col(vector)) & (F.size(vector) > 0)).select(F.col(key), fixed_point(F.col(vector)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, x in blocks_of(batches, "x"):
            f = fits[x.shape[1]]
            w, k = f.whitened(x), len(f.values)
            flat = w.reshape(-1)
            yield pa.RecordBatch.from_pydict({
                key: own.column(key).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(flat), f.n, dtype=np.int64)),
                "deviation": pa.array(deviations(f, x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "whitened": pa.array(flat, mask=np.isnan(flat)),
                "explained": pa.array(np.tile(f.values / f.trace if f.trace > 0 else np.zeros(k), len(x))),
                "identity_error": pa.array(np.full(len(flat), f.identity_error)),
            })

    kind = embeddings.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
