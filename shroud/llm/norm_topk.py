"""Exact top-k by inner product over norm-sorted, SVD-rotated vectors.

The rotation comes from the Gram matrix of all vectors (one distributed sum;
only its d*d entries reach the driver), so the leading rotated components carry
most of the product.  Vectors are dealt into stripes by length, longest first, over
the whole table, and sorted within a stripe; none is copied.  The queries go to the
tasks in blocks of bounded bytes, one pass over the vectors for each block.  The first
stripe's ``SEEDS`` longest vectors give every query a k-th best score to begin with,
which each task carries on.

A task goes down its stripe part by part.  Queries whose length times the part's
longest falls below their k-th best score are left out; for the others the partial
products over the leading components (one matrix product) plus the Cauchy-Schwarz
bound of the residuals tell which candidates may still reach it.  Where many may, the
part is scored by one whole product, which is exact in doubles below 2**53; where few
may, only those rows are gathered.  Ties go to the smaller id; bounds are compared
with a slack above rounding error, so ties survive.  A task returns its k best for
each query, and a window ranks these.

Defined results: null vectors, empty vectors and vectors holding null or
non-finite components take no part, nor do rows whose id is null; vectors of
another dimension than the query's are not compared with it; a repeated row is a
candidate as often as it occurs, and asks once; a candidate with the query's own
id is left out; an empty table gives an empty result; other columns are not
read.  Components are taken as ``floor(scale * x)`` in long integers; where
products could pass 2**53 they are summed in Python integers, clamped to the
range of a long.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.llm.common import columns, written

#: Candidates that are scored together, queries beside them, and candidates that give the first bounds.
PART, BESIDE, SEEDS = 1024, 2048, 4096
#: Bytes of a block of queries: what goes to every task.
BLOCK_BYTES = 1 << 25
#: Share of a part's pairs from which on the whole part is scored.
MANY = 0.05
BEST = "query_id bigint, vec_id bigint, score bigint"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks if len(c)]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.zeros((0, dim), dtype=np.int64)


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``vec_id``, ``v`` (array of long), ``dim`` of the vectors that take part."""
    x = columns(vectors, vec_id=id_col, x=vec_col)
    if not isinstance(x.schema["x"].dataType, T.ArrayType):
        raise TypeError(f"{vec_col} must be an array column")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform("x", lambda e: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), e.cast("double") * scale))))
    return (
        x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
        .where(~F.coalesce(bad, F.lit(True)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("x").alias("dim"))
    )


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors of all its vectors, by falling singular value."""

    def gram(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            t = pa.Table.from_batches([batch])
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                m = _matrix(t.filter(pa.array(dims == d)).column("v"), int(d)).astype(np.float64)
                sums[int(d)] = sums.get(int(d), 0) + m.T @ m
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(s.ravel())], ["dim", "cell", "s"])

    cells = vectors.mapInArrow(gram, "dim int, cell int, s double").groupBy("dim", "cell").agg(F.sum("s").alias("s")).collect()
    grams: dict[int, np.ndarray] = {}
    for dim, cell, s in cells:
        grams.setdefault(dim, np.zeros(dim * dim))[cell] = s
    return {d: np.linalg.eigh(g.reshape(d, d))[1][:, ::-1].copy() if np.isfinite(g).all() else np.eye(d) for d, g in grams.items()}


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row integer products, as long."""
    if q.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] >= 2.0**53:
        return np.array([max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for a, b in zip(q, c, strict=True)], dtype=np.int64)
    return np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64)).astype(np.int64)


class Queries:
    """A block of queries with their k best candidates so far."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, rot: np.ndarray, k: int, leading: int):
        self.qid, self.q, self.k, self.leading, self.rot = qid, q, k, leading, rot
        self.rotated = q @ rot
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.rest = np.sqrt((self.rotated[:, leading:] ** 2).sum(axis=1))
        self.floor = np.full(len(qid), -np.inf)
        empty = np.zeros(0, np.int64)
        self.best = (empty, empty, empty)  # query number, candidate, score
        self.scored = 0

    def _take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = (np.concatenate(both) for both in zip(self.best, (rows, ids, scores), strict=True))
        order = np.lexsort((ids, ~scores, rows))  # ~x falls as x rises, for every long
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        keep = place < self.k
        self.best = rows[keep], ids[keep], scores[keep]
        full = place[keep] == self.k - 1
        held = self.best[0][full]
        self.floor[held] = np.maximum(self.floor[held], self.best[2][full])

    def meet(self, cid: np.ndarray, c: np.ndarray) -> None:
        """Score the candidates (longest first) that may be among the best."""
        if not len(self.qid):
            return
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
        rotated = c @ self.rot
        rest = np.sqrt((rotated[:, self.leading :] ** 2).sum(axis=1))
        slack = 1.0 + 1e-9 * float(self.norm.max()) * float(norm.max())
        whole = float(np.abs(self.q).max()) * float(np.abs(c).max()) * c.shape[1] < 2.0**53
        exact = c.astype(np.float64).T if whole else None
        for at in range(0, len(self.qid), BESIDE):
            live = at + np.flatnonzero(self.norm[at : at + BESIDE] * norm.max() + slack >= self.floor[at : at + BESIDE])
            if not len(live):
                continue
            bound = self.rotated[live, : self.leading] @ rotated[:, : self.leading].T
            bound += np.outer(self.rest[live], rest) + slack
            may = (bound >= self.floor[live, None]) & (self.qid[live, None] != cid[None, :])
            n = int(may.sum())
            self.scored += n
            if whole and n > MANY * may.size:
                scores = np.where(may, self.q[live].astype(np.float64) @ exact, -np.inf)
                own = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] >= self.k else -np.inf  # the part's own k-th best
                rows, cols = np.nonzero(may & (scores >= np.maximum(self.floor[live], own)[:, None]))
                found = scores[rows, cols].astype(np.int64)
            else:
                rows, cols = np.nonzero(may)
                found = _exact(self.q[live[rows]], c[cols])
            if len(rows):
                self._take(live[rows], cid[cols], found)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0, leading_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query`` (a condition on
    ``vec_id``) its k best among all other rows."""
    found = usable(vectors, id_col, vec_col, scale)
    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # longest first over the whole table, and within each stripe
    rows = written(found.withColumn("length", length).repartitionByRange(F.desc("length"), F.asc("vec_id")).sortWithinPartitions(F.desc("length"), F.asc("vec_id")))
    rot = rotations(rows)
    best = None
    for dim, (_, asked) in sorted(_counts(rows, is_query).items()):
        if not asked:
            continue
        own = rows.where(F.col("dim") == dim)
        seeds = own.orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
        parts = max(1, -(-asked * 8 * dim // block_bytes))
        asking = own.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        for part in range(parts):  # about block_bytes each
            block = asking.where(F.col("part") == part).select("vec_id", "v").toArrow()
            if block.num_rows:
                ranked = own.select("vec_id", "v").mapInArrow(_searcher(own, block, seeds, rot[dim], k, max(1, int(dim * leading_share))), BEST)
                best = ranked if best is None else best.unionByName(ranked)
    if best is None:
        best = vectors.sparkSession.createDataFrame([], BEST)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # limited to k per task before the shuffle
    return best.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _counts(rows: DataFrame, is_query: Column) -> dict[int, tuple[int, int]]:
    """Rows and queries of each dimension."""
    return {r["dim"]: (r["n"], r["asked"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked")).collect()}


def _searcher(rows: DataFrame, block: pa.Table, seeds: pa.Table, rot: np.ndarray, k: int, leading: int):
    dim = len(rot)
    ids = lambda t: t.column("vec_id").to_numpy()
    asked = Queries(ids(block), _matrix(block.column("v"), dim), rot, k, leading)
    longest = _matrix(seeds.column("v"), dim)
    for at in range(0, len(longest), PART):  # bounds to begin with: SEEDS rows against the block
        asked.meet(ids(seeds)[at : at + PART], longest[at : at + PART])
    empty = np.zeros(0, np.int64)
    asked.best = (empty, empty, empty)  # the tasks meet these candidates again
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.copy(shared.value)
        own.floor = own.floor.copy()
        for batch in parts:
            cid, c = batch.column(0).to_numpy(), _matrix(pa.chunked_array([batch.column(1)]), dim)
            for at in range(0, len(cid), PART):
                own.meet(cid[at : at + PART], c[at : at + PART])
        rows, ids, scores = own.best
        yield pa.RecordBatch.from_arrays([pa.array(own.qid[rows]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run
