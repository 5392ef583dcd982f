"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.session import ensure_checkpoint_dir

#: ASCII white space, the separator class of the word contracts: space and 0x09-0x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each action in the block when it ends: its
    result lies in the shared folder or with the driver, and nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, far smaller than a checkpoint."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra
    columns of the input (whatever they are called) never clash."""
    return df.select(*(df[src].alias(dst) for dst, src in names.items()))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def batches(iterator: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, to bound a task's memory."""
    for batch in iterator:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value, body):
    """``body`` applied to ``value``, which is evaluated once per row (a one-element
    ``transform``), also where ``body`` names it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_each(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """One of the rows of equal keys, and of these ``limit`` at most, by hash.  The keys stand for
    the text (its hash, what was read off it), so that no whole text meets another in a task."""
    return rows.dropDuplicates(keys).orderBy(F.xxhash64(keys[-1], keys[0]), keys[-1], *keys[:-1]).limit(limit)


#: Bytes of the words of the search contracts: A-Z lower-cased, all other ASCII but digits and letters as space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ascii_words(text: bytes) -> list[bytes]:
    """The maximal runs of digits, letters and bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


class WordHashes(dict):
    """64-bit hash of a word; keeps at most ``ENTRIES`` short words."""

    ENTRIES, LONGEST = 1 << 16, 40

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.ENTRIES:
                self.clear()
            self[word] = value
        return value


#: Bits of a hash filter: 2 MB, whatever the number of keys.
FILTER_BITS = 24


def hash_filter(keys: DataFrame, column: str, size: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of the long ``column`` (by its low bits): no false negatives,
    a fixed size; with many keys it lets more through, and the join behind it decides."""
    bit = F.col(column).bitwiseAND((1 << size) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(one).alias("w")).toArrow()  # at most 2**(size - 6) rows
    out = np.zeros(1 << size - 6, dtype=np.uint64)
    out[words.column("at").to_numpy()] = words.column("w").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys the filter lets through."""
    low = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) != 0
