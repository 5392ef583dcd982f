"""Embedding whitening from exact bit-sliced cross-products.

The vectors become integers, and each distinct one counts once.  A task takes blocks
of vectors, shifts every dimension by its smallest value in the block, cuts it into
bit planes and packs each plane across the rows into 64-bit words.  The product sum
of two dimensions is then the sum over their planes of ``2**(p + q)`` times the set
bits of the planes' AND; the shift is taken out again exactly.  Spark sums the blocks'
results cell by cell in 32-bit limbs, so nothing is rounded before the covariance
``(n * C - S S') / n**2`` has been centred in integers; only its d*d cells reach the
driver, for ``eigh``.  Rows are then projected task by task.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries
are dropped; ids may be null or repeated, every remaining row is answered by itself;
vectors of another length form a fit of their own; fewer than ``k`` dimensions give as
many components; entries beyond 2**62 in size count as 2**62.  A component without
variance (its eigenvalue within rounding of 0, as for equal vectors) has ``whitened``
0 and takes no part in ``identity_error``.  A deviation that no long holds is null, and
``deviation_digits`` has its digits (else null).  An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.llm.common import columns, cut

#: Rows whose planes are packed together, and bytes that a block's vectors may have.
BLOCK, BLOCK_BYTES = 8192, 1 << 26
LIMB, LIMBS = 32, 6
COMPONENTS = 4


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``vec_id, dim, x`` (array of long) of the rows that take part."""
    rows = columns(vectors, vec_id=id_col, v=vec_col)
    if not isinstance(rows.schema["v"].dataType, T.ArrayType):
        raise TypeError(f"{vec_col} must be an array column")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    edge = 2.0**62
    whole = F.transform("v", lambda e: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), e.cast("double") * scale))))
    return rows.where(F.size("v") > 0).where(~F.coalesce(bad, F.lit(True))).select("vec_id", F.size("v").alias("dim"), whole.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors (columns ``dim``, ``x``) as matrices of equal dimension and bounded size."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in parts:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            own = _matrix(batch.filter(pa.array(dims == dim)).column(1), dim)
            most = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
            for at in range(0, len(own), most):
                held.setdefault(dim, []).append(own[at : at + most])
                if sum(map(len, held[dim])) >= most:
                    yield np.concatenate(held.pop(dim))
    for own in held.values():
        yield np.concatenate(own)


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes of the columns of ``y`` (unsigned), with each one's column and power of two."""
    packed, owner, power = [], [], []
    pad = -len(y) % 64
    for j in range(y.shape[1]):
        for p in range(int(y[:, j].max()).bit_length()):
            bit = ((y[:, j] >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(np.pad(bit, (0, pad))).view(np.uint64))
            owner.append(j)
            power.append(p)
    width = (len(y) + pad) // 64
    return np.array(packed, dtype=np.uint64).reshape(-1, width), np.array(owner, dtype=np.int64), np.array(power, dtype=np.int64)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and product sums of the columns of the integer matrix ``x`` (the latter for i <= j), as Python integers."""
    rows, dim = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # wraps round to the true difference
    sliced, owner, power = planes(y)
    wide = object if len(power) and 2 * int(power.max()) + rows.bit_length() + 8 >= 62 else np.int64
    cross = np.zeros((dim, dim), dtype=object)
    sums = np.zeros(dim, dtype=object)
    weight = np.array([1 << int(p) for p in power], dtype=object).astype(wide)
    if len(owner):
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        ones = np.bitwise_count(sliced).sum(axis=1, dtype=np.int64).astype(wide) * weight
        sums[owner[firsts]] = np.add.reduceat(ones, firsts)
        for j, at in zip(owner[firsts].tolist(), firsts.tolist(), strict=True):
            later = firsts[firsts >= at] - at
            total = np.zeros(len(later), dtype=wide)
            for a in range(at, at + int((owner == j).sum())):
                counts = np.bitwise_count(sliced[a] & sliced[at:]).sum(axis=1, dtype=np.int64).astype(wide)
                total = total + np.add.reduceat(counts * weight[at:], later) * weight[a]
            cross[j, owner[at + later]] = total
    base = low.astype(object)
    full = cross + np.multiply.outer(base, sums) + np.multiply.outer(sums, base) + rows * np.multiply.outer(base, base)
    return sums + rows * base, full


def _limbs(value: int) -> list[int]:
    """``value`` in limbs of 32 bits, the last one signed."""
    return [(value >> LIMB * i) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [value >> LIMB * (LIMBS - 1)]


class Fit(NamedTuple):
    """Of one dimension: rows, sums, and the components by falling eigenvalue (columns)."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def whole(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > 1e-13 * max(self.trace, 0.0)


def fit(distinct: DataFrame, k: int) -> dict[int, Fit]:
    """A fit for each dimension of the distinct vectors (``dim, x``)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for block in blocks(parts):
            sums, cross = cross_products(block)
            own = totals.setdefault(block.shape[1], [0, 0, 0])
            own[:] = own[0] + len(block), own[1] + sums, own[2] + cross
        for dim, (n, sums, cross) in totals.items():
            i, j = np.triu_indices(dim)
            cells = np.r_[-1, np.arange(dim), dim + i * dim + j]  # the rows, the sums, the product sums
            values = np.array([_limbs(int(v)) for v in [n, *sums, *cross[i, j]]], dtype=np.int64)
            names = ["dim", "cell", *(f"l{m}" for m in range(LIMBS))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), dim, np.int32)), pa.array(cells), *(pa.array(values[:, m]) for m in range(LIMBS))], names)

    limbs = [f"l{m}" for m in range(LIMBS)]
    cells = distinct.select("dim", "x").mapInArrow(run, "dim int, cell bigint, " + ", ".join(f"{m} bigint" for m in limbs))
    summed = cells.groupBy("dim", "cell").agg(*(F.sum(m).alias(m) for m in limbs)).collect()  # d * (d + 3) / 2 + 1 rows for a dimension
    exact: dict[int, dict[int, int]] = {}
    for dim, cell, *parts in summed:
        exact.setdefault(dim, {})[cell] = sum(v << LIMB * m for m, v in enumerate(parts))
    return {dim: _components(dim, own, k) for dim, own in exact.items()}


def _components(dim: int, cells: dict[int, int], k: int) -> Fit:
    n, sums = cells[-1], [cells[i] for i in range(dim)]
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = (n * cells[dim + i * dim + j] - sums[i] * sums[j]) / (n * n)  # of integers: rounded once
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    return Fit(n, sums, axes[:, order].copy(), np.maximum(values[order], 0.0), float(np.trace(cov)))


def whitened(x: np.ndarray, own: Fit) -> np.ndarray:
    """The rows of ``x`` on the components, each of variance 1 over the fit list."""
    mean = np.array([s / own.n for s in own.sums])
    root = np.where(own.whole, np.sqrt(own.values), np.inf)
    return (x.astype(np.float64) - mean) @ own.axes / root


def deviations(x: np.ndarray, own: Fit) -> list[int]:
    """Exact sums over the dimensions of ``(n * x - S)**2``."""
    largest = max(own.n * max(abs(int(x.max())), abs(int(x.min()))) + abs(s) for s in own.sums)
    if largest**2 * x.shape[1] < 2**63:
        return ((own.n * x - np.array(own.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((own.n * int(c) - s) ** 2 for c, s in zip(row, own.sums, strict=True)) for row in x]


def _identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per dimension the largest entry of the whitened covariance minus the identity, measured over the fit list."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for block in blocks(parts):
            own = fits[block.shape[1]]
            z = np.c_[np.ones(len(block)), whitened(block, own)]
            totals[block.shape[1]] = totals.get(block.shape[1], 0.0) + z.T @ z
        for dim, t in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, dim, np.int32)), pa.array(np.arange(t.size, dtype=np.int32)), pa.array(t.ravel())], ["dim", "cell", "s"])

    found: dict[int, np.ndarray] = {}
    for dim, cell, s in distinct.select("dim", "x").mapInArrow(run, "dim int, cell int, s double").groupBy("dim", "cell").agg(F.sum("s").alias("s")).collect():  # (k + 1)**2 rows for a dimension
        found.setdefault(dim, np.zeros((len(fits[dim].values) + 1) ** 2))[cell] = s
    out = {}
    for dim, flat in found.items():
        own, z = fits[dim], flat.reshape(len(fits[dim].values) + 1, -1)
        cov = z[1:, 1:] / own.n - np.outer(z[0, 1:], z[0, 1:]) / own.n**2
        keep = np.flatnonzero(own.whole)
        out[dim] = float(np.abs(cov[np.ix_(keep, keep)] - np.eye(len(keep))).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, scale: float = 256.0) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits``:
    a row for each remaining vector and component."""
    rows = cut(integers(vectors, id_col, vec_col, scale))
    distinct = cut(rows.select("dim", "x").dropDuplicates(["dim", "x"]))
    fits = fit(distinct, k)
    errors = _identity_errors(distinct, fits)
    name = rows.schema["vec_id"].dataType.simpleString()

    def projected(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                yield _answer(part.column(0), _matrix(part.column(2), dim), fits[dim], errors[dim])

    return rows.select("vec_id", "dim", "x").mapInArrow(
        projected, f"vec_id {name}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"
    )


def _answer(ids: pa.Array, x: np.ndarray, own: Fit, error: float) -> pa.RecordBatch:
    k, rows = len(own.values), len(x)
    exact = deviations(x, own)
    long = [d if d < 2**63 else None for d in exact]
    digits = [None if d < 2**63 else str(d) for d in exact]
    share = own.values / own.trace if own.trace > 0 else np.zeros(k)
    each: Callable[[list], list] = lambda values: [v for v in values for _ in range(k)]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(np.repeat(np.arange(rows), k))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
            pa.array(np.full(rows * k, own.n, np.int64)),
            pa.array(each(long), pa.int64()),
            pa.array(whitened(x, own).ravel()),
            pa.array(np.tile(share, rows)),
            pa.array(np.full(rows * k, error)),
            pa.array(each(digits), pa.string()),
        ],
        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
    )
