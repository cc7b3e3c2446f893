"""Embedding whitening from a bit-sliced scatter matrix.

Entries become whole numbers x = floor(FACTOR * c) + SHIFT. Each task takes its
rows in blocks, subtracts the block's smallest x per dimension, and packs every
bit plane of a dimension across the rows into 64-bit words. The popcount of the AND of
two planes, weighted by the planes' powers of two, gives the exact sum of
products of two dimensions; shifts are undone in whole numbers of any size. The
engine adds the tasks' sums as decimals. Only these sums, one per pair of dimensions,
reach the driver, which centres them as integers (n * sum(xy) - sum(x) * sum(y)),
rounds once, and takes the eigenvectors. Two more scans project the rows: one
measures the covariance of what comes out, one returns it.

A hot vector needs no care: each row adds to its own task's sums, and no row is
shuffled.

Defined results: vectors that are null, empty, or hold null or non-finite
entries, or entries of 2^40 or more in size (their x and its square would leave exact
ranges), take no part; vectors of different dimension are whitened apart, each
dimension by its own fit list; repeated rows and rows without an id count
as any other; components whose eigenvalue is zero to rounding do not exist, so a single
vector, or equal ones, give no rows; deviation is null where it does not fit
its type; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTOR = 64
SHIFT = 1_000_000
COMPONENTS = 32
BLOCK = 4_096
LARGEST = 2.0**40
SAFE = 1 << 62  # sums below it are taken in 64-bit integers
OUT_ROWS = 65_536

_SUMS = "dim int, i int, j int, total decimal(38,0)"
_MOMENTS = "dim int, i int, j int, n double, first double, second double, product double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), sound.alias("sound")) \
        .where("v IS NOT NULL AND sound AND size(v) > 0").select("vec_id", "v")


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values * FACTOR).astype(np.int64) + SHIFT


def by_dimension(batch: pa.RecordBatch):
    """(dim, positions, matrix of doubles) for the rows of each dimension, at most BLOCK at a time."""
    column = batch.column(batch.schema.get_field_index("v"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), BLOCK):
            some = rows[at:at + BLOCK]
            yield dim, some, flat[offsets[some][:, None] + np.arange(dim)]


# --- sums of products ----------------------------------------------------------
def bit_planes(values: np.ndarray) -> np.ndarray:
    """(bits, dims, words): bit k of every dimension of non-negative values, packed over the rows."""
    rows, dims = values.shape
    bits = max(1, int(values.max()).bit_length())
    padded = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = values.T
    return np.stack([
        np.packbits((padded >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for k in range(bits)])


def products(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the dimensions and of their products, as Python integers."""
    rows, dims = values.shape
    low = values.min(axis=0)
    planes = bit_planes(values - low)
    bits, _, words = planes.shape
    flat = planes.reshape(bits * dims, words)
    counts = np.zeros((bits * dims, bits * dims), np.int64)
    for at in range(bits * dims):
        both = np.bitwise_count(flat[at] & flat[at:]).sum(axis=1, dtype=np.int64)
        counts[at, at:] = both
        counts[at:, at] = both
    counts = counts.reshape(bits, dims, bits, dims)
    kind = np.int64 if rows << 2 * bits < SAFE else object
    square = np.zeros((dims, dims), kind)
    for k in range(bits):
        for m in range(bits):
            square = square + counts[k, :, m, :].astype(kind) * (1 << (k + m))
    one = np.zeros(dims, kind)
    for k in range(bits):
        # A plane ANDed with itself counts its own bits.
        one = one + np.diagonal(counts[k, :, k, :]).astype(kind) * (1 << k)
    square, one, low = square.astype(object), one.astype(object), low.astype(object)
    return one + rows * low, square + np.outer(one, low) + np.outer(low, one) + rows * np.outer(low, low)


def _sums(batches):
    found: dict[int, list] = {}
    for batch in batches:
        for dim, _, values in by_dimension(batch):
            one, square = products(whole(values))
            if dim in found:
                old = found[dim]
                found[dim] = [old[0] + len(values), old[1] + one, old[2] + square]
            else:
                found[dim] = [len(values), one, square]
    for dim, (n, one, square) in found.items():
        i, j = np.tril_indices(dim)
        total = [n, *one.tolist(), *square[i, j].tolist()]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(total), dim, np.int32)),
            pa.array(np.concatenate(([-1], np.arange(dim), i)).astype(np.int32)),
            pa.array(np.concatenate((np.full(dim + 1, -1), j)).astype(np.int32)),
            pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
        ], names=["dim", "i", "j", "total"])


class Fit:
    """n, the sums, and the scaled components of one dimension."""

    def __init__(self, dim: int, sums: dict[tuple[int, int], int], components: int):
        self.n = n = sums[-1, -1]
        self.sums = [sums[i, -1] for i in range(dim)]
        centred = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i + 1):
                centred[i, j] = centred[j, i] = (n * sums[i, j] - self.sums[i] * self.sums[j]) / (n * n)
        values, vectors = np.linalg.eigh(centred)
        values, vectors = values[::-1], vectors[:, ::-1]
        real = values > max(values[0], 0) * dim * np.finfo(float).eps
        take = min(components, int(real.sum()))
        self.explained = values[:take] / np.trace(centred) if take else values[:0]
        self.scaled = vectors[:, :take] / np.sqrt(values[:take])
        self.error: float | None = None

    def centre(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        bound = self.n * int(np.abs(x).max()) + max(map(abs, self.sums))
        kind = np.int64 if bound < SAFE else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n).astype(np.float64) @ self.scaled


def fits(good: DataFrame, components: int) -> dict[int, Fit]:
    """The fit of each dimension; the driver holds one number per pair of dimensions."""
    rows = good.select("v").mapInArrow(_sums, _SUMS).groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect()
    sums: dict[int, dict] = defaultdict(dict)
    for r in rows:
        sums[r.dim][r.i, r.j] = int(r.total)
    return {dim: Fit(dim, found, components) for dim, found in sums.items()}


# --- projection ------------------------------------------------------------------
def _moments(known: dict[int, Fit]):
    """Centred co-moments of each block's whitened rows."""
    def run(batches):
        for batch in batches:
            for dim, _, values in by_dimension(batch):
                fit = known[dim]
                white = fit.project(fit.centre(whole(values)))
                mean = white.mean(axis=0)
                scatter = (white - mean).T @ (white - mean)
                i, j = np.tril_indices(white.shape[1])
                size = np.full(len(i), float(len(white)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                    pa.array(size), pa.array(size * mean[i]), pa.array(size * mean[j]),
                    pa.array(scatter[i, j] + size * mean[i] * mean[j]),
                ], names=["dim", "i", "j", "n", "first", "second", "product"])
    return run


def measure(good: DataFrame, known: dict[int, Fit]) -> None:
    """Set each fit's error: the largest entry of the whitened covariance minus the identity."""
    sums = good.select("v").mapInArrow(_moments(known), _MOMENTS).groupBy("dim", "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "first", "second", "product")])
    covariance = F.col("product") / F.col("n") - (F.col("first") / F.col("n")) * (F.col("second") / F.col("n"))
    gap = F.abs(covariance - (F.col("i") == F.col("j")).cast("double"))
    for r in sums.groupBy("dim").agg(F.max(gap).alias("gap")).collect():
        known[r.dim].error = r.gap


def _whitened(known: dict[int, Fit]):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for dim, rows, values in by_dimension(batch):
                fit = known[dim]
                take = fit.scaled.shape[1]
                if not take:
                    continue
                z = fit.centre(whole(values))
                large = dim * int(np.abs(z).max()) ** 2 >= SAFE
                deviation = (z.astype(object) ** 2 if large else z * z).sum(axis=1).tolist()
                fits_in = [Decimal(d) if d < 10**38 else None for d in deviation]
                white = fit.project(z)
                step = max(1, OUT_ROWS // take)
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(np.repeat(some, take))),
                        pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), len(some))),
                        pa.array(np.full(len(some) * take, fit.n, np.int64)),
                        pa.array(fits_in[at:at + step], pa.decimal128(38, 0)).take(
                            pa.array(np.repeat(np.arange(len(some)), take))),
                        pa.array(white[at:at + step].ravel()),
                        pa.array(np.tile(fit.explained, len(some))),
                        pa.array(np.full(len(some) * take, fit.error)),
                    ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    good = usable(rows)
    known = fits(good, components)
    measure(good, known)
    return good.mapInArrow(
        _whitened(known), "vec_id long, component int, n long, deviation decimal(38,0), whitened double,"
        " explained double, identity_error double")
