"""Benchmark decontamination by winnowing.

Documents and benchmark items are read as words.  Of every ``WINDOW`` consecutive
hashes of ``GRAM``-word grams the smallest is kept (the last of equal ones) as a
fingerprint; as ``WINDOW + GRAM - 1`` is the length of a window of the contract, two
texts that share such a window keep a common fingerprint inside it.  Documents'
fingerprints are joined with the benchmark's, and each meeting is extended word by
word to both sides as far as a window can reach: a run of a whole window or more is a
hit, so hash collisions never count.

An item of fewer words than a window is one window of its own length: documents keep
every gram of such a length (there are nine lengths at most).

Only what may meet is kept: a filter of fixed size (``hash_filter``) over the
benchmark's hashes goes to the tasks, and a document's row keeps its passing
fingerprints with the words around them.  The benchmark's side is distinct
(gram, words around) contexts, so a passage that many items share is compared once; a
context knows its set of items by a class.  Contexts up to ``BROADCAST_ROWS`` (counted)
are broadcast; beyond that both sides are shuffled, the documents' dealt over
``SALTS`` copies of each context, so that a passage that many documents share does not
meet in one task.

Defined results: null, empty and wordless texts have no words and are not
contaminated; repeated rows and null document ids are answered row by row; items of
equal text are all listed, an id that occurs on several rows counts once; an item
without an id marks words but is not listed; an empty documents table gives an empty
result, an empty benchmark leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import WordHashes, ascii_words, batches, columns, cut, hash_filter, let, may_hold, texts

#: Words of a gram, and grams of which one is kept: together they span a window of ten words.
GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Contexts that are broadcast at most (some 200 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 200_000
SALTS = 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<h:bigint,pos:bigint,gram:string,before:array<string>,after:array<string>>>"
_HIT_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes; grams of different sizes differ."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + words[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the smallest of each ``WINDOW`` neighbours, the last of equal ones."""
    if len(grams) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    last = WINDOW - 1 - view[:, ::-1].argmin(axis=1)
    return np.unique(last + np.arange(len(view)))


def fingerprints(text: bytes, hashes: WordHashes, lengths: list[int], bits: np.ndarray | None) -> tuple[int, list[dict]]:
    """Number of words, and the kept grams with the words around them; ``lengths``: of whole short items."""
    words = ascii_words(text)
    hashed = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    found: list[dict] = []
    for size, every in ((GRAM, False), *((n, True) for n in lengths)):
        grams = gram_hashes(~hashed if every else hashed, size)  # short items never meet winnowed grams
        at = np.arange(len(grams)) if every else winnowed(grams)
        if bits is not None:
            at = at[may_hold(bits, grams[at])]
        around = 0 if every else SPAN - GRAM
        for p, h in zip(at.tolist(), grams[at].view(np.int64).tolist(), strict=True):
            text_of = lambda part: [w.decode() for w in part]
            before = text_of(words[max(0, p - around) : p])[::-1]
            found.append({"h": h, "pos": p, "gram": b" ".join(words[p : p + size]).decode(), "before": before, "after": text_of(words[p + size : p + size + around])})
    return len(words), found


def _fingerprinted(rows: DataFrame, name: str, lengths: list[int], bits: np.ndarray | None, whole_items: bool) -> DataFrame:
    """``name, n_words, hits`` of every row; of items, a short one's only gram is itself."""
    kind = rows.schema[name].dataType.simpleString()
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)  # fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), None if shared is None else shared.value
        for batch in batches(parts):
            counts, hits = [], []
            for text in texts(batch.column(1)):
                own = lengths
                if whole_items:
                    n = len(ascii_words(text))
                    own = [n] if 0 < n < SPAN else []
                n, found = fingerprints(text, hashes, own, held)
                counts.append(n)
                hits.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, _HIT_TYPE)], [name, "n_words", "hits"])

    return rows.select(name, "text").mapInArrow(run, f"{name} {kind}, n_words bigint, hits {HITS}")


def _equal_words(a: Column, b: Column) -> Column:
    """How many words of two lists are equal from the front."""
    return let(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda z: F.when(F.array_position(z, False) > 0, F.array_position(z, False) - 1).otherwise(F.size(z)))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every document row: the hit words' number
    and stretches (from and before, in words from 0), and the items' ids as sorted strings."""
    bench = cut(_fingerprinted(columns(items, item_id=item_id, text=text_col), "item_id", [], None, True))
    lengths = sorted(r[0] for r in bench.where((F.col("n_words") > 0) & (F.col("n_words") < SPAN)).select("n_words").distinct().collect())  # nine at most
    placed = bench.select("item_id", F.explode("hits").alias("c")).select(F.col("item_id").cast("string").alias("item"), "c.h", "c.gram", "c.before", "c.after")
    contexts = cut(placed.groupBy("h", "gram", "before", "after").agg(F.sort_array(F.collect_set("item")).alias("listed")))
    classes = contexts.select(F.xxhash64("listed").alias("cls"), "listed").dropDuplicates(["cls"])
    contexts = contexts.select("h", F.col("gram").alias("c_gram"), F.col("before").alias("c_before"), F.col("after").alias("c_after"), F.xxhash64("listed").alias("cls"))
    bits = hash_filter(contexts, "h")

    rows = cut(_fingerprinted(columns(docs, doc_id=doc_id, text=text_col), "doc_id", lengths, bits, False)).withColumn("row", F.monotonically_increasing_id())
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    clean = rows.where(F.size("hits") == 0).select("doc_id", "n_words", nothing.alias("spans"), F.array().cast("array<string>").alias("items"))
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("d")).select("row", "d.*")
    if contexts.count() <= broadcast_rows:
        met = hits.join(F.broadcast(contexts), "h")
    else:
        salted = hits.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int"))
        met = salted.join(contexts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["h", "salt"])
    met = met.where(F.col("gram") == F.col("c_gram")).select("row", "pos", F.size(F.split("gram", " ")).alias("size"), _equal_words(F.col("before"), F.col("c_before")).alias("left"), _equal_words(F.col("after"), F.col("c_after")).alias("right"), F.size("c_before").alias("c_left"), F.size("c_after").alias("c_right"), "cls")
    # a short item is its whole gram and has no words around it; all others need a whole window
    short = (F.col("c_left") == 0) & (F.col("c_right") == 0)
    run = F.col("left") + F.col("size") + F.col("right")
    met = met.where(F.when(short, run == F.col("size")).otherwise(run >= SPAN))
    spans = met.select("row", "cls", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("size") + F.col("right")).alias("end"))
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("cls").alias("classes"))
    named = per_row.select("row", F.explode("classes").alias("cls")).join(classes, "cls").groupBy("row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("listed")))).alias("items"))
    marked = per_row.drop("classes").join(named, "row")
    touched = rows.where(F.size("hits") > 0).select("row", "doc_id", "n_words").join(marked, "row", "left")
    touched = touched.select("doc_id", "n_words", F.coalesce("spans", nothing).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    both = clean.unionByName(touched)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n")),
        lambda acc: acc["n"],
    )
    return both.select("doc_id", "n_words", covered.alias("n_hit"), "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts, the items as a hash of their sorted ids."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
