"""Ranked lexical search by exact inner products over sparse ball trees.

A document is the sparse vector of its terms' integer weights, an item the vector of
its terms' numbers; the score is their inner product.  Only the terms of the items
count in it, so vectors are kept on these.

Items are parted into blocks of bounded size, each of which goes to the tasks as it
is.  A task reads documents, gathers them into groups and builds a ball tree over
each: a node has the centroid of its documents and the largest distance from it.  For
an item q no document below a node scores above ``<q, centroid> + |q| * radius`` (made
larger than any rounding error).  Subtrees are taken best bound first and left as soon
as their bound is below the item's tenth best score so far, which a task carries from
tree to tree; at the leaves scores are summed in 64-bit integers.  A task returns its
ten best for each item, and a window ranks these.  Documents are neither shuffled nor
copied; corpus numbers (N, L, df) are summed by Spark before, over all documents.

Defined results: null and termless texts score nothing and are no documents of N; an
item without terms, or none of whose terms occurs, has no rows; repeated document rows
each take a rank, null document ids come last among equal scores; every item row is
ranked by itself, also if its id is null or repeated; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import ascii_words, batches, columns, cut, hash_filter, may_hold, texts

#: Documents and vector entries of a tree, and documents of a leaf.
TREE_ROWS, TREE_ENTRIES, LEAF = 4096, 1 << 20, 64
#: Different (item, term) pairs of a block of items, about: what a task holds of the queries.
BLOCK_TERMS = 200_000
#: Terms that a task counts before it hands the counts on.
COUNTED_AT_ONCE = 500_000


# ------------------------------------------------------------------------------ corpus numbers


def _term_counts(items: DataFrame) -> DataFrame:
    """``query`` (a row number), ``item_id, term, times`` of the items."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            counted = [Counter(ascii_words(t)) for t in texts(batch.column(1))]
            at = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    batch.column(2).take(pa.array(at)),
                    pa.array([t for c in counted for t in c], pa.binary()),
                    pa.array([n for c in counted for n in c.values()], pa.int64()),
                ],
                ["item_id", "query", "term", "times"],
            )

    numbered = cut(items).withColumn("query", F.monotonically_increasing_id())
    return cut(numbered.select("item_id", "text", "query").mapInArrow(run, f"item_id {kind}, query bigint, term binary, times bigint"))


def _corpus(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df`` for the terms that may be the items', and under a null term ``df`` = N, ``length`` = L."""
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(terms.select(F.xxhash64("term").alias("h")), "h"))  # fixed size
    passing = _Passing

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n, length = passing(bits.value), Counter(), 0, 0

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64()), pa.nulls(len(held), pa.int64())], ["term", "df", "length"])
            held.clear()
            return out

        for batch in batches(parts):
            for text in texts(batch.column(0)):
                words = ascii_words(text)
                n, length = n + (len(words) > 0), length + len(words)
                held.update(filter(known.__getitem__, set(words)))
            if len(held) >= COUNTED_AT_ONCE:
                yield counted()
        yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["term", "df", "length"])

    found = docs.select("text").mapInArrow(run, "term binary, df bigint, length bigint")
    return cut(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")))


class _Passing(dict):
    """Whether a word passes the filter of the items' terms; a bounded memory of short words."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __missing__(self, word: bytes) -> bool:
        import xxhash

        # Spark's xxhash64 of a binary value: seed 42
        found = bool(may_hold(self.bits, np.array([xxhash.xxh64_intdigest(word, seed=42)], dtype=np.uint64))[0])
        if len(word) <= 40:
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = found
        return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ------------------------------------------------------------------------------ trees


class Vectors(NamedTuple):
    """Sparse rows one after another: row i has the entries ``first[i]`` up to ``first[i + 1]``."""

    row: np.ndarray
    first: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def only(self, keep: np.ndarray) -> "Vectors":
        size = np.diff(self.first)
        entries = np.repeat(keep, size)
        return Vectors(self.row[keep], np.r_[0, np.cumsum(size[keep])], self.index[entries], self.value[entries])

    def times(self, dense: np.ndarray) -> np.ndarray:
        """Inner products of all rows (none is empty) with a dense vector."""
        return np.add.reduceat(dense[self.index] * self.value, self.first[:-1])


class Node(NamedTuple):
    terms: np.ndarray  # the centroid's entries that are not 0
    centroid: np.ndarray
    radius: float
    children: tuple["Node", ...]
    leaf: Vectors | None


def tree(rows: Vectors, squares: np.ndarray, dim: int, leaf: int = LEAF) -> Node:
    """A ball tree; ``squares``: the rows' squared lengths."""
    center = np.bincount(rows.index, weights=rows.value, minlength=dim) / len(rows.row)
    square = float(center @ center)
    apart = np.maximum(squares - 2.0 * rows.times(center) + square, 0.0)
    radius = math.sqrt(float(apart.max()) + 1e-9 * (float(squares.max()) + square))  # above the rounding of the differences
    terms = np.flatnonzero(center)
    if len(rows.row) <= leaf:
        return Node(terms, center[terms], radius, (), rows)

    def dense(i: int) -> np.ndarray:
        out = np.zeros(dim)
        entries = slice(rows.first[i], rows.first[i + 1])
        out[rows.index[entries]] = rows.value[entries]
        return out

    one = int(apart.argmax())
    from_one = squares - 2.0 * rows.times(dense(one)) + squares[one]
    two = int(from_one.argmax())
    from_two = squares - 2.0 * rows.times(dense(two)) + squares[two]
    side = from_one < from_two
    if side.all() or not side.any():  # equal rows: any halves
        side = np.arange(len(rows.row)) * 2 < len(rows.row)
    return Node(terms, center[terms], radius, tuple(tree(rows.only(s), squares[s], dim, leaf) for s in (side, ~side)), None)


class Best:
    """The k best (score, id) of an item so far; a null id counts as the largest."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], 1  # a score of 0 is no hit

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows = heapq.nsmallest(self.k, self.rows + [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids, strict=True)])
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def search(root: Node, terms: np.ndarray, times: np.ndarray, dense: np.ndarray, ids: list, best: Best) -> int:
    """The item's best among the tree's documents; ``dense``: zeros, as many as terms, given back so.
    Returns the number of leaves that were scored."""
    dense[terms] = times
    length = math.sqrt(float((times.astype(np.float64) ** 2).sum()))
    scored = 0

    def bound(node: Node, above: float) -> float:
        return min(above, (float(dense[node.terms] @ node.centroid) + length * node.radius) * (1 + 1e-9) + 1.0)

    heap = [(-bound(root, math.inf), 0, root)]
    pushed = 1
    while heap and -heap[0][0] >= best.floor:
        at, _, node = heapq.heappop(heap)
        if node.leaf is None:
            for child in node.children:
                heapq.heappush(heap, (-bound(child, -at), pushed, child))
                pushed += 1
            continue
        scored += 1
        scores = node.leaf.times(dense)
        good = np.flatnonzero(scores >= best.floor)
        if len(good):
            best.add(scores[good], [ids[r] for r in node.leaf.row[good].tolist()])
    dense[terms] = 0
    return scored


# ------------------------------------------------------------------------------ the search


class Queries(NamedTuple):
    """A block of items: terms with their weights, and each item's (term, times)."""

    terms: list[bytes]
    weights: np.ndarray
    queries: np.ndarray
    first: np.ndarray
    index: np.ndarray
    times: np.ndarray


def _block(rows: pa.Table, n_docs: int) -> Queries:
    rows = rows.sort_by("query")
    terms = rows.column("term").combine_chunks().dictionary_encode()
    names, df = terms.dictionary.to_pylist(), rows.column("df").to_numpy()
    index = terms.indices.to_numpy()
    weights = np.zeros(len(names), dtype=np.int64)
    weights[index] = [weight(n_docs, int(d)) for d in df]
    queries, first = np.unique(rows.column("query").to_numpy(), return_index=True)
    return Queries(names, weights, queries, np.r_[first, len(index)], index, rows.column("times").to_numpy())


def _impacts(words: list[bytes], known: dict[bytes, int], weights: np.ndarray, n_docs: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's entries: terms of the block and ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``."""
    counted = Counter(filter(known.__contains__, words))
    index = np.fromiter(map(known.__getitem__, counted), dtype=np.int64, count=len(counted))
    tf = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
    m = 100 - 75 + 75 * len(words) * n_docs // length
    value = weights[index] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
    return index[value > 0], value[value > 0]


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents."""
    docs = columns(docs, doc_id=doc_id, text=text_col)
    asked = _term_counts(columns(items, item_id=item_id, text=text_col))
    corpus = _corpus(docs, asked)
    sums = corpus.where("term is null").first()
    n_docs, length = (sums["df"], sums["length"]) if sums else (0, 0)
    known = cut(asked.join(corpus.where("term is not null").select("term", "df"), "term"))  # terms of no document score nothing
    parts = max(1, -(-known.count() // block_terms))
    kinds = f"query bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    found = None
    for part in range(parts):  # one scan of the documents for each block of items
        own = known.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).select("query", "term", "times", "df").toArrow()  # about block_terms rows
        if own.num_rows:
            best = docs.mapInArrow(_searcher(docs, _block(own, n_docs), n_docs, length, k), kinds)
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], kinds)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select("query", "item_id").dropDuplicates(["query"])
    return ranked.join(named, "query").select("item_id", "rank", "doc_id", "score")


def _searcher(docs: DataFrame, block: Queries, n_docs: int, length: int, k: int):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = shared.value
        known = {t: i for i, t in enumerate(own.terms)}
        dense = np.zeros(len(own.terms), dtype=np.int64)
        best = [Best(k) for _ in own.queries]
        ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def searched() -> None:
            size = np.array([len(i) for i, _ in held])
            rows = Vectors(np.arange(len(held)), np.r_[0, np.cumsum(size)], np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
            root = tree(rows, np.add.reduceat(rows.value.astype(np.float64) ** 2, rows.first[:-1]), len(dense))
            for q in range(len(best)):
                entries = slice(own.first[q], own.first[q + 1])
                search(root, own.index[entries], own.times[entries], dense, ids, best[q])
            ids.clear()
            held.clear()

        entries = 0
        for batch in batches(parts):
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                index, value = _impacts(ascii_words(text), known, own.weights, n_docs, length)
                if not len(index):
                    continue
                ids.append(doc)
                held.append((index, value))
                entries += len(index)
                if len(held) >= TREE_ROWS or entries >= TREE_ENTRIES:
                    searched()
                    entries = 0
        if held:
            searched()
        rows = [(int(q), i if not null else None, -s) for q, b in zip(own.queries, best, strict=True) for s, null, i in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], batch_type), pa.array([r[2] for r in rows], pa.int64())], ["query", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return run
