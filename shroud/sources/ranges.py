"""Text files of any size, read in byte ranges and handed on as chunks.

Spark's text reader plans the ranges (``spark.sql.files.maxPartitionBytes``) on any
file system that Spark reads, and settles them at line ends, so a range never ends
inside a character.  A task puts the lines of its range together and cuts them behind
seams (``functions.seams``): what lies before its first seam and behind its last one
may belong to a match with the neighbouring range, so these fragments are joined with
the neighbours' by their order in the file.  The result is the chunk rows of
``operators.chunked``; no value and no task ever holds a whole file.  The list of files
and the pieces of their ranges are written to the shared checkpoint folder, the only copy
of the texts that is made here; nothing reads the files after that.

Defined results: the texts are what the whole file's would be, with universal newlines
and strict UTF-8: a file with other bytes has one row without text and the reason in
``error``, as has a file with another suffix.  Spark's listing skips empty files and
names that start with ``.`` or ``_``.  A single line must fit into a value (2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroud.config import RedactionConfig
from shroud.functions import rules as R
from shroud.functions.seams import cut, seam_pattern
from shroud.operators import chunked
from shroud.sources.files import file_suffix

#: What a task makes of its range: the fragment up to its first seam, whole chunks, and
#: the fragment behind its last seam; a range without a seam is one inner fragment.
HEAD, BODY, TAIL, INNER = range(4)
#: Files whose names and lengths are sent to every task.
SENT_FILES = 10_000
_PIECES = "path string, split bigint, seq bigint, kind int, piece string, bytes bigint, bad boolean, returned boolean"


def listed(spark: SparkSession, path: str, extensions: Sequence[str] | None = R.TEXT_SUFFIXES, recursive: bool = True) -> DataFrame:
    """``path, name, length, known`` of every file; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    known = F.lit(True) if extensions is None else file_suffix(F.col("name")).isin(*[e.lower() for e in extensions])
    return files.select("path", "name", "length", known.alias("known"))


def _cut_ranges(lines: DataFrame, marks: str, chunk_chars: int) -> DataFrame:
    """The pieces of every range, from its lines in order (``path, split, value, bytes``; a value that is no UTF-8 is null)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = seam_pattern(marks)
        out: list[tuple] = []
        at: tuple | None = None  # the range that is being read
        held: list[str] = []
        state = {"size": 0, "bytes": 0, "seq": 0, "bad": False, "cut": False, "returned": False}

        def put(kind: int, piece: str, n_bytes: int = 0) -> None:
            out.append((*at, state["seq"], kind, piece, n_bytes, state["bad"], state["returned"]))
            state["seq"] += 1

        def cut_held(end: bool) -> None:
            """Whole chunks of what is held; the rest stays, or is the range's last fragment."""
            text = "".join(held).replace("\r\n", "\n").replace("\r", "\n")
            held.clear()
            if not state["cut"]:
                first = pattern.search(text)
                if first is None:
                    if end:
                        put(INNER, text, state["bytes"])
                    else:
                        held.append(text)
                    return
                put(HEAD, text[: first.end()])
                text, state["cut"] = text[first.end() :], True
            pieces = list(cut(text, pattern, chunk_chars))
            for piece in pieces[:-1]:
                put(BODY, piece)
            rest = pieces[-1]
            if not end:
                held.append(rest)
                return
            last = max((m.end() for m in pattern.finditer(rest)), default=0)
            if last:
                put(BODY, rest[:last])
            put(TAIL, rest[last:], state["bytes"])

        def flushed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["path", "split", "seq", "kind", "piece", "bytes", "bad", "returned"])
            out.clear()
            return rows

        for batch in parts:
            for path, split, value, n_bytes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != (path, split):
                    if at is not None:
                        cut_held(True)
                    at = (path, split)
                    state.update(size=0, bytes=0, seq=0, bad=False, cut=False)
                state["bytes"] += n_bytes + 1
                state["bad"] |= value is None
                state["returned"] = (value or "").endswith("\r")
                held.append((value or "") + "\n")
                state["size"] += len(held[-1])
                # "\r\n" is one line end: nothing is cut between its two characters, as a line ends with it
                if state["size"] >= 4 * chunk_chars:
                    cut_held(False)
                    state["size"] = 0
                if sum(len(r[4]) for r in out[-8:]) and len(out) >= 128:
                    yield flushed()
        if at is not None:
            cut_held(True)
        if out:
            yield flushed()

    return lines.select("path", "split", "value", "bytes").mapInArrow(run, _PIECES)


def read_text_chunks(
    spark: SparkSession,
    path: str,
    extensions: Sequence[str] | None = R.TEXT_SUFFIXES,
    config: RedactionConfig | None = None,
    normalize: str = "nfkc",
    chunk_chars: int = chunked.CHUNK_CHARS,
    recursive: bool = True,
) -> DataFrame:
    """``path, name, row, block, idx, chunk_text, error``: the files' normalised texts as
    chunks for ``operators.chunked.redact_chunks`` with the keys ``path`` and ``name``.

    ``config`` must be the one the chunks are redacted with: it decides where they may be cut.
    """
    marks = chunked.active_seams(config)
    files = chunked.settled(listed(spark, path, extensions, recursive))
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_name").alias("name"), "value")
    if extensions is not None:
        lines = lines.where(file_suffix(F.col("name")).isin(*[e.lower() for e in extensions]))
    checked = lines.select("path", "split", F.when(F.is_valid_utf8("value"), F.col("value")).alias("value"), F.octet_length("value").cast("long").alias("bytes"))
    pieces = chunked.settled(_cut_ranges(checked, marks, chunk_chars))

    # fragments are few: a head and a tail for each range
    place = Window.partitionBy("path").orderBy("split", "seq")
    fragments = pieces.where(F.col("kind") != BODY)
    groups = fragments.withColumn("joined", F.sum((F.col("kind") == TAIL).cast("long")).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ordered = F.sort_array(F.collect_list(F.struct("split", "seq", "piece", "returned")))
    seam_chunks = groups.groupBy("path", "joined").agg(ordered.alias("f")).select(
        "path", F.element_at("f", 1)["split"].alias("split"), F.element_at("f", 1)["seq"].alias("seq"), F.array_join(F.transform("f", lambda x: x["piece"]), "").alias("piece"), F.element_at("f", -1)["returned"].alias("returned"), F.row_number().over(Window.partitionBy("path").orderBy(F.desc("joined"))).alias("from_end")
    )
    bodies = pieces.where(F.col("kind") == BODY).select("path", "split", "seq", "piece", F.lit(False).alias("returned"), F.lit(0).alias("from_end"))
    # every line was given a line end: the file's length tells whether its last one has it (a byte-order mark may
    # have been read over); after a "\r" it is part of that line end
    read = pieces.groupBy("path").agg(F.sum("bytes").alias("read"), F.max("bad").alias("bad"))
    known = files.where("known").join(read, "path", "left")
    bad = F.coalesce("bad", F.lit(False))
    unended = (F.col("read") == F.col("length") + 1) | (F.col("read") == F.col("length") - 2)
    of_file = known.where(~bad).select("path", "name", unended.alias("unended"))
    # texts stay where they are: a list of files is small beside them, which Spark cannot tell before it has dealt out both
    texts = bodies.unionByName(seam_chunks).join(F.broadcast(of_file) if files.count() <= SENT_FILES else of_file, "path")
    texts = texts.withColumn("piece", F.when(F.col("unended") & ~F.col("returned") & (F.col("from_end") == 1), F.expr("substring(piece, 1, length(piece) - 1)")).otherwise(F.col("piece")))
    block = (F.col("split") + F.floor(F.col("seq") / chunked.BLOCK)).cast("long")
    row = F.col("path").alias(chunked.ROW)
    rows = texts.select("path", "name", row, block.alias(chunked.BLOCK_COL), F.col("seq").alias(chunked.IDX), F.col("piece").alias(chunked.TEXT), F.lit(None).cast("string").alias("error"))
    zero = F.lit(0).cast("long")
    unread = lambda df, why: df.select("path", "name", row, zero.alias(chunked.BLOCK_COL), zero.alias(chunked.IDX), F.lit(None).cast("string").alias(chunked.TEXT), F.lit(why).alias("error"))
    rows = rows.unionByName(unread(known.where(bad), "invalid utf-8")).unionByName(unread(files.where("NOT known"), "unsupported file type"))
    return chunked.normalized(rows, normalize)
