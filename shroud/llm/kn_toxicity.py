"""Toxicity by class-conditional Kneser-Ney models.

Word models: every labelled document's words, unfolded (lower-cased runs of letters,
marks and digits of any script; other signs one by one), are counted as pairs of
neighbours.  A task adds up its own pairs first; Spark sums these, and words, contexts
and continuation counts all come from the one table of pairs, so what is gathered
grows with the input.  A class's probability of a word behind another is the
discounted share of the pair plus, for what is left, the shared backoff: the number of
different words of either class that stand before it (and the same one order lower).
Words and pairs whose share in the classes differs by chance at most (``LEAST_G``, a
relative entropy of their counts) are left to the shared backoff, which is the same
for both classes: their ratio is 0.  The others' log ratios are a table keyed by a
64-bit hash.  Grams of more than one in ``FREQUENT`` of all places, which are few, are
broadcast and summed where the text is read.  A text's other grams that a filter of fixed
size lets through are dealt into buckets by their keys, and so is the rest of the table:
many grams travel packed in one row, a task holds the weights of one bucket
(``BUCKET_ROWS`` on average) and the grams pass it block by block, however many they are.
What comes back are sums by row.

Character models: one of toxic and one of ordinary texts, of order five, for words
that were never learned.  They share their lower orders: what neither class has seen
backs off to continuation counts pooled over both.  Characters are read through a
fixed alphabet of 32 signs (space, a-z, five classes of other bytes), so this part
has at most 2**25 grams; its counts are summed by Spark over the same documents.

A text's features are the word models' ratio per place of each order and its largest
one, the character models' mean ratio and that of its most toxic words; a logistic,
fitted on labelled documents that were not counted, gives the score.

Defined results: null and empty texts are scored as texts without words;
repeated rows and null ids are kept row by row (a row without an id is never
learned from); labels that are null teach nothing, a label that occurs twice
is counted twice, and fits the logistic once; if one class has no labelled document, or the documents table is
empty, every text gets the share of toxic labels; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import WordHashes, batches, columns, hash_filter, may_hold, one_each, texts, written

#: 0 space and everything that is no letter, 1-26 a-z, 27-31 bytes above 0x7F.
SIGNS = bytes(b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 27 + b % 5 if b >= 128 else 0 for b in range(256))
BITS, ORDER = 5, 5
GRAMS, CONTEXTS = 1 << BITS * ORDER, 1 << BITS * (ORDER - 1)
#: Characters that are counted together in a task.
COUNTED_AT_ONCE = 2_000_000
#: Word pairs that are counted together in a task, and rows of a table of pairs that are taken apart together.
PAIRS_AT_ONCE, APART_AT_ONCE = 1 << 19, 1 << 20
#: Labels that are broadcast at most (some 20 bytes each); beyond, Spark shuffles both sides.
LABEL_ROWS = 2_000_000
#: A pair of ordinary texts only is weighed from so many places on; fewer cannot tell the classes apart.
LEAST_PLAIN = 4
#: Labelled documents, at most, on which the logistic is fitted.
FIT_ROWS = 6000
#: Grams of more than one in so many places are at most so many words and pairs each; other weights that a task holds at once, on average (17 bytes each).
FREQUENT, BUCKET_ROWS = 1 << 20, 1_000_000
#: Grams of texts that are packed together, and those that pass a bucket, on average.
BLOCK, BUCKET_GRAMS = 1 << 18, 1 << 23
#: Bits of the filter of the other grams' keys (two probes a key), whatever their number: 8 MB.
RARE_BITS = 26
#: A gram is weighed if 2 * n * relative entropy (of its classes' counts to the corpus') reaches this: one in ten by chance.
LEAST_G = 2.71
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]")
#: The same words of ASCII alone, by the faster module; and what is beyond ASCII.
ASCII_WORDS, BEYOND_ASCII = re.compile(r"\w+|[^\s\w]", re.ASCII), re.compile(r"[^\x00-\x7f]+")
FEATURES = ("mean", "top", "word1", "word2", "most")


def signs(text: bytes) -> np.ndarray:
    """The text's signs, single spaces between words, as many in front as a context holds."""
    read = b"".join((b"\0" * (ORDER - 1), b"\0".join(filter(None, text.translate(SIGNS).split(b"\0"))), b"\0"))
    return np.frombuffer(read, dtype=np.uint8)


def codes(s: np.ndarray) -> np.ndarray:
    """The gram that ends at each sign behind the first context."""
    n = len(s) - ORDER + 1
    out = np.zeros(n, dtype=np.int32)
    for i in range(ORDER):
        out <<= BITS
        out |= s[i : i + n]
    return out


def gram_counts(labelled: DataFrame) -> DataFrame:
    """From ``text, toxic``: ``gram``, ``n_toxic``, ``n_plain`` over all rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def counted() -> Iterator[pa.RecordBatch]:
            for label, arrays in enumerate(held):
                if arrays:
                    gram, n = np.unique(np.concatenate(arrays), return_counts=True)
                    zero = np.zeros(len(gram), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(n if label else zero, pa.int64()), pa.array(zero if label else n, pa.int64())], ["gram", "n_toxic", "n_plain"])
                    arrays.clear()

        size = 0
        for batch in batches(parts):
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                c = codes(signs(text))
                for at in range(0, len(c), COUNTED_AT_ONCE):
                    held[int(toxic)].append(c[at : at + COUNTED_AT_ONCE])
                    size += len(held[int(toxic)][-1])
                    if size >= COUNTED_AT_ONCE:
                        yield from counted()
                        size = 0
        yield from counted()

    found = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "gram int, n_toxic bigint, n_plain bigint")
    return found.groupBy("gram").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_plain").alias("n_plain"))


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one else 0.5


def shared_backoff(gram: np.ndarray) -> np.ndarray:
    """P(last sign | the signs before it) for every gram of one order less, from the
    continuation counts of the grams seen in either class."""
    tables = [np.bincount(gram & (CONTEXTS - 1), minlength=CONTEXTS).astype(np.float64)]
    while len(tables[-1]) > 1 << BITS:  # how many different signs stand before a shorter gram
        tables.append((tables[-1] > 0).reshape(1 << BITS, -1).sum(axis=0).astype(np.float64))
    p = np.full(1 << BITS, 1.0 / (1 << BITS))
    for n in reversed(tables):
        rows = n.reshape(-1, 1 << BITS)
        total = rows.sum(axis=1, keepdims=True)
        d = _discount(n)
        lower = p.reshape(-1, 1 << BITS) if len(n) > 1 << BITS else p.reshape(1, -1)
        lower = np.tile(lower, (len(rows) // len(lower), 1))  # the context without its first sign
        with np.errstate(invalid="ignore", divide="ignore"):
            own = (np.maximum(rows - d, 0) + d * (rows > 0).sum(axis=1, keepdims=True) * lower) / total
        p = np.where(total > 0, own, lower).ravel()
    return p


def ratio_table(gram: np.ndarray, n_toxic: np.ndarray, n_plain: np.ndarray) -> np.ndarray:
    """log P(sign | context, toxic) - log P(sign | context, plain) of every gram."""
    order = np.argsort(gram)
    gram, sides = gram[order].astype(np.int64), (n_toxic[order].astype(np.float64), n_plain[order].astype(np.float64))
    back = shared_backoff(gram)
    context = gram >> BITS
    below = back[gram & (CONTEXTS - 1)]
    seen, unseen = np.zeros(len(gram)), np.zeros(CONTEXTS, dtype=np.float32)
    for sign, n in zip((1, -1), sides, strict=True):
        d = _discount(n)
        total = np.bincount(context, weights=n, minlength=CONTEXTS)
        kinds = np.bincount(context, weights=n > 0, minlength=CONTEXTS)
        with np.errstate(invalid="ignore", divide="ignore"):
            left = np.where(total > 0, d * kinds / total, 1.0)
        t = total[context]
        seen += sign * np.log(np.where(t > 0, np.maximum(n - d, 0) / np.maximum(t, 1), 0) + left[context] * below)
        unseen += (sign * np.log(left)).astype(np.float32)
    table = np.repeat(unseen.astype(np.float16), 1 << BITS)
    table[gram] = seen
    return table


def features(table: np.ndarray, text: bytes) -> tuple[float, float]:
    """Mean ratio per character, and the mean of the three most toxic words' ratios."""
    s = signs(text)
    if len(s) <= ORDER:
        return 0.0, 0.0
    ratio = table[codes(s)].astype(np.float32)
    ends = np.flatnonzero(s[ORDER - 1 :] == 0)
    words = np.add.reduceat(ratio, np.r_[0, ends[:-1] + 1])
    top = np.partition(words, -3)[-3:] if len(words) > 3 else words
    return float(ratio.mean()), float(top.sum() / 3)


START, END = np.uint64(0), np.uint64(1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """``WORDS.findall(text)``; only what lies between two spaces around signs beyond ASCII needs their classes."""
    found, at = [], 0
    for run in () if text.isascii() else BEYOND_ASCII.finditer(text):
        if run.start() >= at:
            lo, hi = text.rfind(" ", at, run.start()), text.find(" ", run.end())
            lo, hi = at if lo < 0 else lo, len(text) if hi < 0 else hi
            found += ASCII_WORDS.findall(text, at, lo)
            found += WORDS.findall(text, lo, hi)
            at = hi
    return found + ASCII_WORDS.findall(text, at)


def word_hashes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words between a start and an end."""
    words = words_of(text.decode().lower())
    return np.r_[START, np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)), END]


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (before * _MULTIPLIER) ^ (word + (before >> np.uint64(29)))
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(31))


def pair_counts(labelled: DataFrame) -> DataFrame:
    """From ``text, toxic``: ``v, w`` (hashes of neighbours), ``n_toxic``, ``n_plain``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, size = WordHashes(), 0
        held: list[tuple[np.ndarray, np.ndarray, int]] = []

        def counted() -> pa.RecordBatch:
            v, w = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            toxic = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
            order = np.lexsort((w, v))
            v, w, toxic = v[order], w[order], toxic[order]
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            n, t = np.diff(np.r_[first, len(v)]), np.add.reduceat(toxic, first)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(t, pa.int64()), pa.array(n - t, pa.int64())], ["v", "w", "n_toxic", "n_plain"])

        for batch in batches(parts):
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                h = word_hashes(text, hashes)
                for at in range(0, len(h) - 1, PAIRS_AT_ONCE):
                    held.append((h[:-1][at : at + PAIRS_AT_ONCE], h[1:][at : at + PAIRS_AT_ONCE], int(toxic)))
                    size += len(held[-1][0])
                    if size >= PAIRS_AT_ONCE:
                        yield counted()
                        size = 0
        if held:
            yield counted()

    found = labelled.select("text", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).mapInArrow(run, "v bigint, w bigint, n_toxic bigint, n_plain bigint")
    return found.groupBy("v", "w").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_plain").alias("n_plain"))


def _discounts(counts: DataFrame, *names: str) -> dict[str, float]:
    """The share taken from every seen gram, n1 / (n1 + 2 * n2), of each named count."""
    row = counts.agg(*(F.sum((F.col(c) == i).cast("long")).alias(f"{c}_{i}") for c in names for i in (1, 2))).first()
    return {c: row[f"{c}_1"] / (row[f"{c}_1"] + 2 * row[f"{c}_2"]) if row[f"{c}_1"] else 0.5 for c in names}


def _differs(toxic: int, plain: int) -> Column:
    """Whether the gram's counts differ from the corpus' shares by more than chance."""
    n = F.col("n_toxic") + F.col("n_plain")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * share))).otherwise(0.0)
    return 2 * (part("n_toxic", toxic / (toxic + plain)) + part("n_plain", plain / (toxic + plain))) >= LEAST_G


def _ratio(below: Column, discounts: dict[str, float], total: dict[str, Column], kinds: dict[str, Column]) -> Column:
    """log P(toxic) - log P(plain) of a gram, from its counts, its context's and the shared backoff."""
    out = F.lit(0.0)
    for sign, side in ((1.0, "n_toxic"), (-1.0, "n_plain")):
        d, t = discounts[side], total[side]
        left = F.when(t > 0, F.lit(d) * kinds[side] / t).otherwise(1.0)
        out += F.lit(sign) * F.log(F.when(t > 0, F.greatest(F.col(side) - d, F.lit(0.0)) / t).otherwise(0.0) + left * below)
    return out


#: What a table of pairs is taken apart into: words (places, different words before them),
#: contexts (places, different words behind them), numbers of pairs seen once and twice, and the pairs that may be weighed.
WORD, CONTEXT, ONCE_TWICE, PAIR = range(4)


def apart(pairs: DataFrame) -> DataFrame:
    """``kind, v, w, n_toxic, n_plain, toxic_kinds, plain_kinds`` of the summed pairs, added up in the task,
    so that the pairs themselves are shuffled once and written nowhere."""
    names = ["kind", "v", "w", "n_toxic", "n_plain", "toxic_kinds", "plain_kinds"]

    def summed(kind: int, key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        own, zero = key[order][first], np.zeros(len(first), np.int64)
        place = [own, zero] if kind == CONTEXT else [zero, own]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int32)), *map(pa.array, [*place, *(np.add.reduceat(c[order], first) for c in columns)])], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def taken() -> Iterator[pa.RecordBatch]:
            v, w, t, p = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
            held.clear()
            one = np.ones(len(v), np.int64)
            yield summed(WORD, w, [t, p, one, one])  # a pair is one different word before w, of either class
            yield summed(CONTEXT, v, [t, p, (t > 0).astype(np.int64), (p > 0).astype(np.int64)])
            yield summed(ONCE_TWICE, np.zeros(len(v), np.int64), [(t == 1).astype(np.int64), (p == 1).astype(np.int64), (t == 2).astype(np.int64), (p == 2).astype(np.int64)])
            may = np.flatnonzero((t > 0) | (p >= LEAST_PLAIN))
            zero = np.zeros(len(may), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(may), PAIR, np.int32)), *map(pa.array, [v[may], w[may], t[may], p[may], zero, zero])], names)

        size = 0
        for batch in parts:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= APART_AT_ONCE:
                yield from taken()
                size = 0
        if held:
            yield from taken()

    return pairs.select("v", "w", "n_toxic", "n_plain").mapInArrow(run, "kind int, " + ", ".join(f"{n} bigint" for n in names[1:]))


def word_weights(labelled: DataFrame) -> DataFrame | None:
    """``gram, n, ratio, often``: the weighed words (n = 1) and pairs (2); None if either class has no place."""
    parts = written(apart(pair_counts(labelled)))
    sides = ("n_toxic", "n_plain")
    seen = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds")
    words = written(parts.where(F.col("kind") == WORD).groupBy("w").agg(F.sum("toxic_kinds").alias("before"), *(F.sum(c).alias(c) for c in sides)))
    row = words.agg(F.sum("before").alias("before"), F.count("*").alias("words"), *(F.sum(c).alias(c) for c in sides), *(seen(c) for c in sides)).first()
    toxic, plain = row["n_toxic"] or 0, row["n_plain"] or 0
    if not toxic or not plain:
        return None
    # the shared backoff of a word: how many different words stand before it, the rest evenly over all words and one more
    d0 = _discounts(words, "before")["before"]
    floor = d0 * row["words"] / row["before"] / (row["words"] + 1)
    below = (F.greatest(F.col("before") - d0, F.lit(0.0)) / row["before"]) + floor
    one = _ratio(below, _discounts(words, *sides), {c: F.lit(row[c]) for c in sides}, {c: F.lit(row[f"{c}_kinds"]) for c in sides})
    often = ((F.col("n_toxic") + F.col("n_plain")) * FREQUENT > toxic + plain).alias("often")
    weighed = words.where(_differs(toxic, plain)).select(F.col("w").alias("gram"), F.lit(1).alias("n"), one.alias("ratio"), often)
    # pairs that are weighed are few: only these meet their contexts and their words
    kept = parts.where((F.col("kind") == PAIR) & _differs(toxic, plain)).select("v", "w", *sides)
    contexts = parts.where(F.col("kind") == CONTEXT).groupBy("v").agg(*(F.sum(c).alias(f"{c}_total") for c in sides), F.sum("toxic_kinds").alias("n_toxic_kinds"), F.sum("plain_kinds").alias("n_plain_kinds"))
    met = kept.join(contexts, "v").join(words.select("w", below.alias("below")), "w")
    few = parts.where(F.col("kind") == ONCE_TWICE).agg(*(F.sum(c) for c in (*sides, "toxic_kinds", "plain_kinds"))).first()
    taken = {c: few[i] / (few[i] + 2 * few[i + 2]) if few[i] else 0.5 for i, c in enumerate(sides)}
    two = _ratio(F.col("below"), taken, {c: F.col(f"{c}_total") for c in sides}, {c: F.col(f"{c}_kinds") for c in sides})
    found = met.select("v", "w", F.lit(2).alias("n"), two.alias("ratio"), often)

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            v, w = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(v, w).view(np.int64)), *batch.columns[2:]], ["gram", "n", "ratio", "often"])

    return written(weighed.unionByName(found.mapInArrow(keyed, "gram bigint, n int, ratio double, often boolean")))


class Frequent(NamedTuple):
    """The weighed grams that are frequent, by key: at most ``FREQUENT`` words and as many pairs."""

    gram: np.ndarray
    n: np.ndarray  # one byte each
    ratio: np.ndarray

    @classmethod
    def of(cls, weights: DataFrame) -> Frequent:
        rows = weights.where("often").select("gram", "n", "ratio").toArrow()  # 2 * FREQUENT rows
        gram, n, ratio = (rows.column(i).to_numpy() for i in range(3))
        order = np.argsort(gram.view(np.uint64))
        return cls(gram.view(np.uint64)[order], n[order].astype(np.int8), ratio[order])

    def summed(self, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float, float, float | None]:
        """Which of the keys are frequent; their ratios' sums over words and over pairs, and the largest one."""
        at = np.minimum(np.searchsorted(self.gram, key), len(self.gram) - 1)
        held = self.gram[at] == key if len(self.gram) else np.zeros(len(key), bool)
        if not held.any():
            return held, 0.0, 0.0, None
        at, ratio = at[held], self.ratio[at[held]]
        total = times[held] * ratio
        return held, float(total[self.n[at] == 1].sum()), float(total[self.n[at] == 2].sum()), float(ratio.max())


class Model(NamedTuple):
    """The character table, the words' and pairs' ratios (the frequent ones apart, a filter of the
    others' keys), and the logistic."""

    table: np.ndarray
    words: DataFrame | None
    frequent: Frequent | None
    bits: np.ndarray | None
    weights: tuple[float, ...]

    def logit(self) -> Column:
        """Of the columns that ``scored`` gives."""
        out = F.lit(self.weights[0])
        for name, weight in zip(FEATURES, self.weights[1:], strict=False):
            out += F.lit(weight) * F.col(name)
        return out


def _no_model(table: np.ndarray, weights: tuple[float, ...]) -> Model:
    return Model(table, None, None, None, weights)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias first) by Newton steps with a small ridge."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - center) / scale]
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.0, *[0.05] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
    slope = w[1:] / scale
    return np.r_[w[0] - slope @ center, slope]


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """learn, fit: conditions on ``doc_id`` that choose the labelled rows to count and
    those to fit the logistic on (a bounded sample of these, by hash; what it leaves is
    counted too)."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    marks = columns(labels, doc_id="doc_id", toxic=label_col).where("doc_id is not null and toxic is not null")
    chosen = marks.where(fit).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    undrawn = marks.where(F.coalesce(fit, F.lit(False)) & ~F.coalesce(learn, F.lit(False))).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_anti")
    learned = marks.where(learn).unionByName(undrawn)
    small = learned.count() <= LABEL_ROWS
    counted = rows.where(learn | fit).join(F.broadcast(learned) if small else learned, "doc_id").select("text", "toxic")
    grams = gram_counts(counted).toArrow()  # at most 2**25 rows
    gram, n_toxic, n_plain = (grams.column(i).to_numpy() for i in range(3))
    if not n_toxic.sum() or not n_plain.sum():
        share = marks.where(learn).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return _no_model(np.zeros(GRAMS, np.float16), (float(np.log(share / (1 - share))),))
    table, weighed = ratio_table(gram, n_toxic, n_plain), word_weights(counted)
    words, frequent, bits = None, None, None
    if weighed is not None:
        words, frequent = weighed.where("NOT often"), Frequent.of(weighed)
        bits = hash_filter(words.select(F.explode(F.array("gram", F.shiftrightunsigned("gram", 32))).alias("probe")), "probe", RARE_BITS)
    drawn = rows.join(F.broadcast(chosen), "doc_id").withColumn("text_hash", F.xxhash64("text"))
    sample = one_each(scored(drawn, Model(table, words, frequent, bits, ()), ["toxic", "text_hash"]), ["doc_id", "toxic", "text_hash"], fit_rows).toArrow()  # fit_rows rows of numbers
    x = np.stack([sample[c].to_numpy() for c in FEATURES], axis=1)
    y = sample["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(table, words, frequent, bits, (-1.0, 1.0, 1.0))
    return Model(table, words, frequent, bits, tuple(float(v) for v in _logistic(x, y)))


_GRAMS = "array<struct<gram:bigint,times:int>>"


def _read(rows: DataFrame, model: Model, also: list[str]) -> DataFrame:
    """What a task finds in each text alone: ``doc_id``, the columns ``also``, the character features, the
    frequent weights' sums and the other grams that may be weighed."""
    # at most GRAMS half floats, 64 MB, a filter of 8 MB and 2 * FREQUENT weights of 17 bytes, 36 MB
    shared = rows.sparkSession.sparkContext.broadcast((zlib.compress(model.table.tobytes(), 1), model.bits, model.frequent and tuple(model.frequent)))
    given = rows.select("doc_id", "text", *(c for c in also if c != "text"))
    carried = ["doc_id", *also]
    kept = [given.columns.index(c) for c in carried]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, bits, often = shared.value
        held, hashes = np.frombuffer(zlib.decompress(packed), dtype=np.float16), WordHashes()  # a task's own: workers live on
        frequent = often and Frequent(*often)
        for batch in batches(parts):
            found = [features(held, t) for t in texts(batch.column(1))]
            found_keys, found_times, places, sizes, sums = [], [], [], [0], []
            for text in texts(batch.column(1)):
                h = word_hashes(text, hashes)
                places.append(len(h) - 1)
                keys = np.r_[h[1:], pair_keys(h[:-1], h[1:])]
                key, times = np.unique(keys if frequent else keys[:0], return_counts=True)
                if frequent:
                    known, *own_sums = frequent.summed(key, times)
                    sums.append(own_sums)
                    rare = ~known & may_hold(bits, key) & may_hold(bits, key >> np.uint64(32))
                    key, times = key[rare], times[rare]
                else:
                    sums.append((0.0, 0.0, None))
                found_keys.append(key)
                found_times.append(times)
                sizes.append(len(key))
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(found_keys).view(np.int64)), pa.array(np.concatenate(found_times).astype(np.int32))], ["gram", "times"])
            grams = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), each)
            own = [batch.column(i) for i in kept]
            numbers = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)] + [pa.array([f[i] for f in sums], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array(places, pa.int64()), grams], [*carried, "mean", "top", "own1", "own2", "own_most", "places", "grams"])

    kinds = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in carried)
    return given.mapInArrow(run, f"{kinds}, mean double, top double, own1 double, own2 double, own_most double, places bigint, grams {_GRAMS}")


def _numbered(read: DataFrame) -> DataFrame:
    # a row number holds only if every reader sees the same rows: written once
    return written(read).withColumn("row_no", F.monotonically_increasing_id())


_PACKED = "bucket int, kind int, base bigint, gram binary, value binary, no binary"


def _dealt(kind: int, base: int, gram: np.ndarray, value: np.ndarray, no: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that holds any of the keys; the order within a bucket is kept."""
    bucket = (gram % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, gram, value, no = bucket[order], gram[order], value[order], no[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    parts = [[c[i:j].tobytes() for i, j in zip(first, [*first[1:], len(bucket)], strict=True)] for c in (gram, value, no)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first]), pa.array(np.full(len(first), kind, np.int32)), pa.array(np.full(len(first), base, np.int64)), *(pa.array(p, pa.binary()) for p in parts)],
        ["bucket", "kind", "base", "gram", "value", "no"],
    )


def _packed_weights(weights: DataFrame, buckets: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            gram, n, ratio = (batch.column(i).to_numpy() for i in range(3))
            yield _dealt(0, 0, gram.view(np.uint64), ratio, n.astype(np.int8), buckets)

    return weights.select("gram", "n", "ratio").mapInArrow(run, _PACKED)


def _packed_grams(numbered: DataFrame, buckets: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 4096):
            row, grams = batch.column(0).to_numpy(), batch.column(1)
            gram, times = (grams.flatten().field(i).to_numpy() for i in (0, 1))
            sizes = grams.value_lengths().to_numpy()
            no = np.repeat((row - row[0]).astype(np.uint32), sizes) if len(row) else np.zeros(0, np.uint32)  # rows of a batch are neighbours
            for at in range(0, len(gram), BLOCK):
                here = slice(at, at + BLOCK)
                yield _dealt(1, int(row[0]), gram[here].view(np.uint64), times[here].astype(np.int32), no[here], buckets)

    return numbered.select("row_no", "grams").mapInArrow(run, _PACKED)


def _met(dealt: DataFrame) -> DataFrame:
    """``row_no, sum1, sum2, most`` of every block: in each bucket the weights come first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, known = None, [], None
        for batch in parts:
            for i in range(batch.num_rows):
                own, kind, base = (batch.column(j)[i].as_py() for j in range(3))
                value = [batch.column(j)[i].as_buffer() for j in (3, 4, 5)]
                if own != bucket:
                    bucket, held, known = own, [], None
                key = np.frombuffer(value[0], np.uint64)
                if kind == 0:
                    held.append((key.copy(), np.frombuffer(value[2], np.int8).copy(), np.frombuffer(value[1], np.float64).copy()))
                    continue
                if not held:
                    continue
                if known is None:
                    known = [np.concatenate(c) for c in zip(*held, strict=True)]
                    order = np.argsort(known[0])
                    known, held = [c[order] for c in known], held[:1]
                at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
                hit = np.flatnonzero(known[0][at] == key)
                if not len(hit):
                    continue
                n, ratio, no = known[1][at[hit]], known[2][at[hit]], np.frombuffer(value[2], np.uint32)[hit]
                first = np.flatnonzero(np.r_[True, no[1:] != no[:-1]])  # a row's grams stand together
                total = np.frombuffer(value[1], np.int32)[hit] * ratio
                sums = [np.add.reduceat(np.where(n == k, total, 0.0), first) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(base + no[first].astype(np.int64)), *map(pa.array, sums), pa.array(np.maximum.reduceat(ratio, first))], ["row_no", "sum1", "sum2", "most"])

    return dealt.mapInArrow(run, "row_no bigint, sum1 double, sum2 double, most double")


def _features(numbered: DataFrame, weights: DataFrame, also: list[str]) -> DataFrame:
    """``row_no``, the columns ``also`` and the features of numbered rows."""
    zero = F.lit(0.0)
    grams = numbered.agg(F.sum(F.size("grams"))).first()[0] or 0
    buckets = max(numbered.sparkSession.sparkContext.defaultParallelism, -(-weights.count() // BUCKET_ROWS), -(-grams // BUCKET_GRAMS))
    dealt = _packed_weights(weights, buckets).unionByName(_packed_grams(numbered, buckets))
    met = _met(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind"))
    sums = met.groupBy("row_no").agg(F.sum("sum1").alias("sum1"), F.sum("sum2").alias("sum2"), F.max("most").alias("most"))
    joined = numbered.select("row_no", *also, "mean", "top", "own1", "own2", "own_most", "places").join(sums, "row_no", "left")
    per_place = lambda n: ((F.col(f"own{n}") + F.coalesce(f"sum{n}", zero)) / F.greatest("places", F.lit(1))).alias(f"word{n}")
    return joined.select("row_no", *also, "mean", "top", per_place(1), per_place(2), F.coalesce(F.greatest("most", "own_most"), zero).alias("most"))


def _by_signs(read: DataFrame) -> DataFrame:
    """The features where no word is weighed."""
    return read.select("*", *(F.lit(0.0).alias(c) for c in FEATURES[2:]))


def scored(rows: DataFrame, model: Model, also: list[str]) -> DataFrame:
    """``doc_id``, the columns ``also``, and the features of ``text``."""
    read, own = _read(rows, model, also), ["doc_id", *also]
    found = _by_signs(read) if model.words is None else _features(_numbered(read), model.words, own)
    return found.select(*own, *FEATURES)


def harmless(rows: DataFrame, model: Model, also: list[str]) -> DataFrame:
    """The columns ``also`` (``text`` may be one) of the rows that the model does not call toxic.  Only row
    numbers meet the weights; the rows themselves are shuffled only where the toxic ones' numbers are too many to broadcast."""
    read, clean = _read(rows, model, also), F.coalesce(model.logit() < 0, F.lit(False))
    if model.words is None:
        return _by_signs(read).where(clean).select(*also)
    numbered = _numbered(read)
    toxic = _features(numbered, model.words, []).where(~clean).select("row_no")
    return numbered.select("row_no", *also).join(toxic, "row_no", "left_anti").select(*also)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    found = scored(columns(docs, doc_id=id_col, text=text_col), model, [])
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.logit()))
    return found.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
