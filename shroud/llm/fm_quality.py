"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words (lower-cased, hashed into
2**WORD_BITS classes, together of length one), a dozen structure statistics of
the whole text, each as one of sixteen bins, and numeric metadata columns, each
as its power of two.  The score is

    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairwise interactions cost time linear in the features.  The machine is
fitted by AdaGrad on a bounded sample of labelled documents (``fit_rows``, half
of it from each class where there are enough; the bias is corrected for the
classes' true shares); every document is scored whole.  The fitted arrays have a
fixed size.

Defined results: null and empty texts are scored by their statistics; null
metadata has a class of its own; repeated rows and null ids are kept row by row;
labels that are null teach nothing; labels and rows that repeat fit once; if no
label or only one class is known, every text gets the label's share; an empty
table gives an empty result; only id, text and the metadata columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import batches, columns, one_each, texts

WORD_BITS, BINS, STATS, META = 16, 16, 12, 4
STAT_AT = 1 << WORD_BITS
META_AT = STAT_AT + STATS * BINS
META_CLASSES = 66
SIZE = META_AT + META * META_CLASSES
RANK, EPOCHS, FIT_ROWS = 8, 12, 6000
UPPER = re.compile(rb"[A-Z]+")
SYMBOL = bytes(b for b in range(256) if b < 128 and not (chr(b).isalnum() or chr(b).isspace()))
DIGIT, CAPITAL, SMALL = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(np.log2(1 + x)))


def _share_bin(part: float, whole: float) -> int:
    """Shares on a scale that is fine near zero: 0, below 1/2**13, ..., above 1/2."""
    return 0 if not part or not whole else max(1, BINS - 1 - min(BINS - 2, int(-np.log2(min(1.0, part / whole)))))


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Bins of the structure statistics of a whole text."""
    size, n = len(text), len(words)
    count = lambda chars: size - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x]
    letters = count(CAPITAL) + count(SMALL)
    return [
        _log_bin(n),
        min(BINS - 1, size // max(n, 1)),
        _share_bin(count(CAPITAL), letters),
        _share_bin(count(DIGIT), size),
        _share_bin(count(b"#*$%&|<>"), size),
        _share_bin(count(SYMBOL), size),
        _share_bin(n - distinct, n),
        _share_bin(len(lines) - len(set(lines)), len(lines)),
        _log_bin(n / max(len(lines), 1)),
        _log_bin(max(map(len, words), default=0)),
        _share_bin(text.count(b"!"), n),
        _share_bin(text.count(b" | "), n),
    ]


def document(text: bytes, meta: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values."""
    words = text.lower().split()
    distinct = set(words)
    hashed = np.fromiter(map(crc32, distinct), dtype=np.uint32, count=len(distinct)) & np.uint32(STAT_AT - 1)
    stats = [STAT_AT + i * BINS + b for i, b in enumerate(statistics(text, words, len(distinct)))]
    extra = [META_AT + i * META_CLASSES + (0 if m is None or m != m else 1 + min(64, int(np.log2(1 + max(0.0, float(m)))))) for i, m in enumerate(meta[:META])]
    index = np.r_[hashed.astype(np.int64), stats, extra].astype(np.int64)
    value = np.r_[np.full(len(hashed), 1.0 / np.sqrt(max(1, len(hashed)))), np.full(len(stats) + len(extra), 0.3)].astype(np.float32)
    return index, value


class Model(NamedTuple):
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents whose features lie one after the other from ``starts`` on."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def fit(index: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, rank)).astype(np.float32)
    gw, gv, bias, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, rank), 1e-6, np.float32), 0.0, 1e-6
    rate, decay, batch = 0.1, 1e-4, 64
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            starts = np.cumsum([0, *(len(index[i]) for i in own[:-1])])
            i, x = np.concatenate([index[j] for j in own]), np.concatenate([value[j] for j in own])
            doc = np.repeat(np.arange(len(own)), [len(index[j]) for j in own])
            vx = v[i] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            logit = bias + np.add.reduceat(w[i] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[own]) / len(own)
            kinds, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, weights=miss[doc] * x, minlength=len(kinds)) + decay * w[kinds]
            pull = miss[doc][:, None] * x[:, None] * (sums[doc] - vx)
            dv = np.stack([np.bincount(back, weights=pull[:, f], minlength=len(kinds)) for f in range(rank)], axis=1) + decay * v[kinds]
            gw[kinds] += dw**2
            gv[kinds] += dv**2
            w[kinds] -= rate * dw / np.sqrt(gw[kinds])
            v[kinds] -= rate * dv / np.sqrt(gv[kinds])
            gb += miss.sum() ** 2
            bias -= rate * miss.sum() / np.sqrt(gb)
    return Model(float(bias), w, v)


FEATURES = "index array<bigint>, value array<float>"


def _featured(rows: DataFrame, n_meta: int) -> DataFrame:
    """``label, index, value, doc_id, text_hash`` from ``label, text``, the metadata columns, ``doc_id`` and ``text_hash``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            meta = list(zip(*(batch.column(2 + j).to_pylist() for j in range(n_meta)), strict=True)) or [()] * batch.num_rows
            found = [document(t, m) for t, m in zip(texts(batch.column(1)), meta, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float32())), *batch.columns[2 + n_meta :]], ["label", "index", "value", "doc_id", "text_hash"])

    return rows.mapInArrow(run, f"label int, {FEATURES}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint")


def _rows(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...]) -> DataFrame:
    if len(meta_cols) > META:
        raise ValueError(f"at most {META} metadata columns")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("double").alias(f"meta{i}") for i, c in enumerate(meta_cols)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = (), fit_rows: int = FIT_ROWS) -> Model:
    """learn: a condition on ``doc_id`` that chooses the labelled rows to learn from."""
    marks = columns(labels, doc_id="doc_id", label=label_col).where("doc_id is not null and label is not null").where(learn)
    share = {r[0]: r[1] for r in marks.groupBy(F.col("label").cast("int")).agg(F.count("*")).collect()}
    zeros, ones = share.get(0, 0), share.get(1, 0)
    constant = Model(float(np.log((ones + 0.5) / (zeros + 0.5))), np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))
    if not zeros or not ones:
        return constant
    order = [F.xxhash64("doc_id"), "doc_id"]
    once = marks.distinct()
    chosen = once.where("label = 0").orderBy(*order).limit(fit_rows // 2).unionByName(once.where("label = 1").orderBy(*order).limit(fit_rows // 2))
    rows = _rows(docs, id_col, text_col, meta_cols)
    own = rows.join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int").alias("label"), "text", *rows.columns[2:], "doc_id", F.xxhash64("text").alias("text_hash"))
    found = one_each(_featured(own, len(meta_cols)), ["doc_id", "label", "text_hash"], fit_rows).toArrow()
    y = found["label"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return constant
    index = [x.values.to_numpy() for x in found["index"]]
    value = [x.values.to_numpy() for x in found["value"]]
    order_ = sorted(range(len(y)), key=lambda i: (len(index[i]), int(index[i].sum()), float(y[i])))  # the same fit whatever order rows arrive in
    model = fit([index[i] for i in order_], [value[i] for i in order_], y[order_])
    drawn = np.log(max(y.sum(), 0.5) / max((1 - y).sum(), 0.5))
    return model._replace(bias=float(model.bias + np.log(ones / zeros) - drawn))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    rows = _rows(docs, id_col, text_col, meta_cols)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * (RANK + 1) floats

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches(parts, 64):
            meta = list(zip(*(batch.column(2 + j).to_pylist() for j in range(len(meta_cols))), strict=True)) or [()] * batch.num_rows
            found = [document(t, m) for t, m in zip(texts(batch.column(1)), meta, strict=True)]
            logits = np.zeros(0)
            if found:
                starts = np.cumsum([0, *(len(f[0]) for f in found[:-1])])
                logits = held.logits(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -50, 50))), pa.float64())], ["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
