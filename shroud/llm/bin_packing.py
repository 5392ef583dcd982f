"""Best-fit packing of tokenised documents with large-item matching.

Every document becomes its token ids and an end id; only one longer than the
capacity is cut, into pieces of full capacity behind a first piece that may be
shorter.  Pieces of one length are interchangeable, so the packing is decided on
the histogram of lengths: at most ``capacity`` counts, whatever the corpus size.

* Full pieces fill a sequence each.
* Pieces above a third of the capacity (at most two fit together) are matched
  greedily: from the longest down, each open sequence takes the longest such
  piece that still fits beside it.
* Smaller pieces, longest first, go to the sequences with the smallest gap that
  holds them (best fit); what fits nowhere opens new sequences.

The result is a list of patterns (lengths and how many sequences have them).
A step handles a whole run of equal pieces and equal gaps at once; it uses up a
length or a gap, so patterns number at most a few times the capacity.  Pieces
are then numbered within their length (in hash buckets, about the square root of its count, so that
a length with a third of all pieces is spread over tasks) and take the slots of
their length in order.  Slots join by (length, chunk of slot numbers).

Defined results: null and empty texts are the end id alone; repeated rows are
packed as often as they occur; a null ``doc_id`` is kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import batches, columns, cut, texts

CAPACITY = 2048
#: Unicode white space of the tokenizer's pattern: a segment starts where white space follows another character.
WHITE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WHITE_END = re.compile(f"[{WHITE}]\\Z")
#: Bytes, about, of the segments whose ids a worker remembers, each with what Python adds; it starts anew when full.
REMEMBERED, ENTRY = 64_000_000, 200
#: Slots of one length per join key.
SLOT_CHUNK = 4096


#: Fixed value: the pattern of byte-level pre-tokenization.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The pattern never joins white space to what stands before it, so the ids of
    a text are those of its segments in order, and ids of segments seen before
    are remembered.  New segments are encoded joined, by the vocabulary's ranks,
    and parted by the bytes of their tokens; texts that hold an added token's
    string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        vocab, byte = spec["model"]["vocab"], _byte_characters()
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or any(vocab[m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("a byte-level vocabulary in merge order is expected")
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte[ch] for ch in token): i for token, i in vocab.items() if token not in self.added}
        self.ranked = tiktoken.Encoding("segments", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}  # by the segment without its leading space
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        joined = " " + " ".join(words)
        ids = np.array(self.ranked.encode_ordinary(joined), dtype="<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = [0, *(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1).tolist()]
        data = ids.tobytes()
        self.held += len(words) * ENTRY + len(joined) + len(data)
        self.known.update((w, data[4 * s : 4 * e]) for w, s, e in zip(words, cuts, cuts[1:], strict=False))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        first, *words = text.split(" ")
        new = list(set(words).difference(self.known))
        if not first or WHITE_END.search(first) or any(not w or WHITE_END.search(w) for w in new):
            # white space beside white space: part the text by the pattern's own rule
            first, *words = SEGMENT.findall(text)
            if words and WHITE_END.search(words[-1]) or any(w[0] != " " for w in words):
                return self.whole(text)
            words = [w[1:] for w in words]
            new = list(set(words).difference(self.known))
        if new:
            self.learn(new)
        return np.array(self.ranked.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def _segment_ids(path: str) -> SegmentIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return SegmentIds(path)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end = int(end_id).to_bytes(4, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _segment_ids(tokenizer_path)
        for batch in batches(parts):
            source, out, ids = [], [], []
            for i, text in enumerate(texts(batch.column(1))):
                data = encoder.encode(text.decode("utf-8", "replace")) + end
                n = len(data) // 4
                start = 0
                for piece in range(-(-n // capacity)):
                    length = ((n - 1) % capacity + 1) if piece == 0 else capacity
                    own = data[4 * start : 4 * (start + length)]
                    source.append(i)
                    out.append((piece, start, length, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, dtype="<u4").astype(np.int64))
                    start += length
            cols = [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *cols, *[pa.array(ids, pa.list_(pa.int64()))] * with_ids], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}" + ", ids array<bigint>" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for these counts of lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    large = capacity // 3
    # gap -> patterns (count, lengths) that have it
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    if left[capacity]:
        open_[0].append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    for first in range(capacity - 1, large, -1):
        while left[first]:
            second = next((s for s in range(min(first, capacity - first), large, -1) if left[s]), 0)
            if not second:
                n, pattern = int(left[first]), (first,)
            elif second != first:
                n, pattern = int(min(left[first], left[second])), (first, second)
            elif left[first] >= 2:
                n, pattern = int(left[first] // 2), (first, first)
            else:  # the last of its length: the longest other that fits
                second = next((s for s in range(first - 1, large, -1) if left[s]), 0)
                n, pattern = 1, (first, second) if second else (first,)
            for length in pattern:
                left[length] -= n
            open_[capacity - sum(pattern)].append((n, pattern))
    gaps = np.zeros(capacity + 1, dtype=bool)
    for gap in open_:
        gaps[gap] = True
    for length in range(large, 0, -1):
        while left[length]:
            at = length + int(np.argmax(gaps[length:]))
            if not gaps[at]:
                open_[capacity].append((-(-int(left[length]) // (capacity // length)), ()))
                gaps[capacity] = True
                continue
            bins, pattern = open_[at].pop()
            # as many of this length as the gap takes, while pieces last
            each = min(at // length, max(1, int(left[length]) // bins))
            n = min(bins, int(left[length]) // each)
            if n < bins:
                open_[at].append((bins - n, pattern))
            elif not open_[at]:
                del open_[at]
                gaps[at] = False
            open_[at - each * length].append((n, pattern + (length,) * each))
            gaps[at - each * length] = True
            left[length] -= n * each
    return [(n, pattern) for patterns in open_.values() for n, pattern in patterns if pattern]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first slot number, end, first sequence, place in the sequence) of every place of every pattern."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for n, pattern in patterns:
        place = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + n, sequence, place))
            taken[length] += n
            place += length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cutting = cut(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids))
    histogram = {r[0]: r[1] for r in cutting.groupBy("length").agg(F.count("*")).collect()}
    slots = spark.createDataFrame(_slots(plan(histogram, capacity)), "length bigint, lo bigint, hi bigint, sequence0 bigint, offset bigint")
    chunk = lambda c: F.floor(F.col(c) / SLOT_CHUNK)
    slots = slots.select("*", F.explode(F.sequence(chunk("lo"), F.floor((F.col("hi") - 1) / SLOT_CHUNK))).alias("chunk"))
    buckets = max(1, isqrt(max(histogram.values(), default=0)))  # as many as rows in a bucket of the commonest length
    dealt = cutting.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        dealt.withColumn("no", F.row_number().over(within))
        .join(firsts, ["length", "bucket"])
        .withColumn("slot", F.col("first") + F.col("no") - 1)
        .withColumn("chunk", chunk("slot"))
    )
    placed = numbered.join(slots, ["length", "chunk"]).where("slot >= lo and slot < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence0") + F.col("slot") - F.col("lo")).alias("sequence_id"), "offset", *["ids"] * with_ids)
