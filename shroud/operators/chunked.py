"""Texts longer than a row should be, as rows of pieces.

A long text is cut behind seams (``functions.seams``) into chunk rows, so its work is
spread over tasks and no value ever holds the whole redacted text.  What the per-text
form carries along a text becomes prefix sums over its chunks:

* offsets: sums of the chunks' lengths;
* token numbers: sums of the chunks' counts, per prefix;
* output offsets: sums of the rewritten chunks' lengths;
* overlap: hits of rules never cross a seam.  Spans of an external model may; a prefix
  maximum of ends tells which chunks an island of overlapping hits joins, and only the
  hits of those are brought together.

All of these have two levels: sums over blocks of ``BLOCK`` chunks, running over a
text's blocks, and running sums inside a block.  A text's blocks (a few numbers each)
are the most that one task sees of it.

Chunk rows carry a row number from the cut, so texts of equal keys never mix; they are
written to the shared checkpoint folder once, before anything refers to that number.
From there on hits and numbers travel without the texts, which are joined to the result
by place; where it is read without them (``vault``), Spark leaves that join out.

``redact_long`` keeps the chunks of a text that is one block of up to ``TOGETHER_CHARS``
characters in one row, with the places of their ends: no sum has to leave such a row,
and its spans come by key.  Its chunks become rows at the end.  Longer texts go as above.

Defined results: a null text is one chunk with a null text; an empty one, one empty
chunk; chunks in the order of (``block``, ``idx``) concatenate to what ``api.redact``
gives for the whole text, with the same tokens and offsets (as longs).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.functions import rules as R
from shroud.functions.normalize import normalize_column
from shroud.functions.seams import cut, seam_pattern, seams
from shroud.functions.spans import empty, ident, let
from shroud.operators.detect import CAND_TYPE, NER_TYPE, with_candidates
from shroud.operators.ner import coerce_spans
from shroud.operators.redact import redacted_text_sql, replacements_sql, token_prefix_sql, work_sql
from shroud.operators.resolve import resolve_sql
from shroud.session import ensure_checkpoint_dir

ROW, BLOCK_COL, IDX, N, START = "row", "block", "idx", "n_chars", "start"
PLACE = [ROW, BLOCK_COL, IDX]
TEXT = "chunk_text"
RESERVED = {*PLACE, N, START, TEXT}
#: Ends of the chunks that one row holds; null where the row is a chunk.
ENDS = "__ends"
#: Characters of a chunk, at least; chunks of a block.
CHUNK_CHARS, BLOCK = 1 << 16, 64
#: Characters of a text, at most, whose chunks stay in one row.
TOGETHER_CHARS = 1 << 16
#: Characters that a task hands on at a time while it cuts.
HANDED_ON = 1 << 23

REPLACEMENT = (
    "array<struct<original_start:bigint,original_end:bigint,output_start:bigint,output_end:bigint,"
    "token:string,original_value:string,entity_type:string,category:string>>"
)


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: computed once, and the same for every reader."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, part: list[str], value: str, out: str, how: str = "sum") -> DataFrame:
    """``out``: the sum (or max) of ``value`` over the chunks of ``part`` before each one, 0 for the first."""
    aggregate = {"sum": F.sum, "max": F.max}[how]
    both = {"sum": lambda a, b: a + b, "max": F.greatest}[how]
    zero = F.lit(0).cast("long")
    before = lambda w: F.coalesce(aggregate(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero)
    blocks = df.groupBy(*part, BLOCK_COL).agg(aggregate(value).alias(value))
    bases = blocks.select(*part, BLOCK_COL, before(Window.partitionBy(*part).orderBy(BLOCK_COL)).alias("__base"))
    inner = df.withColumn("__inner", before(Window.partitionBy(*part, BLOCK_COL).orderBy(IDX)))
    return inner.join(bases, [*part, BLOCK_COL]).withColumn(out, both(F.col("__inner"), F.col("__base"))).drop("__inner", "__base")


def active_seams(config: RedactionConfig | None) -> str:
    found = seams(config)
    if not found:
        raise ValueError("some rule can match every character at which a text could be cut, or its edges: use api.redact, text by text")
    return found


def normalized(chunks: DataFrame, normalize: str) -> DataFrame:
    """The chunks' texts normalised; a byte-order mark is only stripped at a text's start."""
    if normalize == "none":
        return chunks
    first = (F.col(IDX) == 0) & (F.col(BLOCK_COL) == 0)
    bom = chunks.withColumn(TEXT, F.when(first, F.regexp_replace(TEXT, "^﻿+", "")).otherwise(F.col(TEXT)))
    return bom if normalize == "bom" else normalize_column(bom.withColumn("__raw", F.concat(F.lit("."), TEXT)), "__raw", "__out").withColumn(TEXT, F.expr("substring(__out, 2)")).drop("__raw", "__out")


def _normal(piece: str, normalize: str, first: bool) -> str:
    """``normalized`` of one piece."""
    bare = piece.lstrip("\ufeff") if first and normalize != "none" else piece
    return bare if normalize in ("none", "bom") else unicodedata.normalize("NFKC", bare)


def _cut(df: DataFrame, ks: list[str], text: str, config: RedactionConfig | None, normalize: str, chunk_chars: int, together: int) -> DataFrame:
    """keys, ``row, block, idx, chunk_text, __ends``: a row per chunk as it stands in the text, or, of texts of
    one block and up to ``together`` characters, a row with all chunks, normalised, and their ends."""
    if clash := RESERVED & set(ks):
        raise ValueError(f"key columns named {sorted(clash)} clash with the chunks' own")
    marks = active_seams(config)
    rows = api.spread(df.select(*ks, F.col(text).alias(TEXT))).withColumn(ROW, F.monotonically_increasing_id())
    at = len(ks)
    names = [*ks, ROW, BLOCK_COL, IDX, TEXT, ENDS]

    def joined(value: str | None, pattern) -> tuple[str | None, list[int]] | None:
        """The text and its chunks' ends, if they stay in one row."""
        if len(value or "") > together:
            return None
        own = [_normal(piece, normalize, k == 0) for k, piece in enumerate(cut(value or "", pattern, chunk_chars))]
        ends = [0]
        for piece in own:
            ends.append(ends[-1] + len(piece))
        if len(own) > BLOCK or ends[-1] > together:
            return None
        return (None if value is None else "".join(own)), ends[1:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = seam_pattern(marks)
        for batch in parts:
            held: list[tuple[int, int, str | None, list[int] | None]] = []
            size = 0

            def handed(batch=batch) -> pa.RecordBatch:
                source, idx, texts, ends = map(list, zip(*held))
                own = [batch.column(i).take(pa.array(source, pa.int64())) for i in (*range(at), at + 1)]
                new = [pa.array([i // BLOCK for i in idx], pa.int64()), pa.array(idx, pa.int64()), pa.array(texts, pa.string()), pa.array(ends, pa.list_(pa.int32()))]
                held.clear()
                return pa.RecordBatch.from_arrays([*own, *new], names)

            for i in range(batch.num_rows):
                value = batch.column(at)[i].as_py()
                if whole := joined(value, pattern):
                    found = [(0, *whole)]
                else:
                    found = ((k, piece, None) for k, piece in enumerate([None] if value is None else cut(value, pattern, chunk_chars)))
                for k, piece, ends in found:
                    held.append((i, k, piece, ends))
                    size += len(piece or "")
                    if size >= HANDED_ON:
                        yield handed()
                        size = 0
            if held:
                yield handed()

    kinds = [f"{ident(k)} {rows.schema[k].dataType.simpleString()}" for k in ks]
    return dealt(rows.mapInArrow(run, ", ".join([*kinds, f"{ROW} bigint", f"{BLOCK_COL} bigint", f"{IDX} bigint", f"{TEXT} string", f"{ENDS} array<int>"])))


def chunks(df: DataFrame, keys, text: str, config: RedactionConfig | None = None, normalize: str = "nfkc", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """keys, ``row, block, idx, chunk_text``: every text in chunks, normalised."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    return settled(normalized(_cut(df, ks, text, config, normalize, chunk_chars, -1).drop(ENDS), normalize))


def dealt(pieces: DataFrame) -> DataFrame:
    """The chunks over ``spark.sql.shuffle.partitions`` tasks (a given number, so that they are not
    put together again by size): a long text leaves one task, and detection costs far more per byte."""
    return pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACE)


def _usable_spans(ner: DataFrame, ks: list[str], config: RedactionConfig) -> DataFrame:
    """Spans of an external table with an active label and a place that can be."""
    wanted = [label for labels, toggle in ((R.NER_PERSON_LABELS, "names"), (R.NER_LOCATION_LABELS, "addresses")) if config.enabled(toggle) for label in labels]
    return coerce_spans(ner, ks).where(F.col("label").isin(*wanted)).where("start >= 0 AND start < `end`")


def _model_spans(placed: DataFrame, ner: DataFrame, ks: list[str], config: RedactionConfig) -> DataFrame:
    """``row, block, idx, __ner``: the candidates of an external span table in the chunk where each starts.

    Spans and chunks meet in ranges of ``CHUNK_CHARS`` characters of their key, an
    equi-join whose groups are as small as the ranges; a pair counts in the range where
    the later of both starts.  The values of spans over several chunks are put together
    from their slices.
    """
    width = F.lit(CHUNK_CHARS).cast("long")
    by_label = [(R.NER_PERSON_LABELS, "PERSON", "pii", R.NER_PERSON_EMISSION), (R.NER_LOCATION_LABELS, "LOCATION", "location", R.NER_LOCATION_EMISSION)]
    spans = _usable_spans(ner, ks, config).distinct().select(*ks, F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "label")
    ranges = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    extents = placed.where(F.col(N) > 0).select(*ks, *PLACE, F.col(START).alias("c"), (F.col(START) + F.col(N)).alias("d"))
    totals = extents.groupBy(ROW).agg(F.max("d").alias("total"))
    left = spans.withColumn("range", ranges(F.col("s"), F.col("e")))
    right = extents.withColumn("range", ranges(F.col("c"), F.col("d")))
    pairs = left.join(right, [*ks, "range"]).where("s < d AND c < e").where(F.col("range") == F.floor(F.greatest("s", "c") / width))
    pairs = settled(pairs.join(totals, ROW).where("e <= total").select(*PLACE, "s", "e", "label", "c", "d"))
    # slices of what a chunk does not hold alone
    split = pairs.where("s < c OR e > d")
    slices = split.join(placed.select(*PLACE, TEXT), PLACE).select(ROW, "s", "e", "label", "c", F.expr(f"substring({TEXT}, CAST(greatest(s - c, 0) AS INT) + 1, CAST(least(e, d) - greatest(s, c) AS INT))").alias("part"))
    values = slices.groupBy(ROW, "s", "e", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "part"))), lambda p: p["part"]), "").alias("whole"))
    starting = pairs.where("s >= c").join(values, [ROW, "s", "e", "label"], "left")

    def pick(i: int) -> Column:
        out = F.lit(None)
        for spec in by_label:
            out = F.when(F.col("label").isin(*spec[0]), F.lit(spec[i])).otherwise(out)
        return out

    priority = F.when(pick(2) == "pii", R.CATEGORY_PRIORITY["pii"]).otherwise(R.CATEGORY_PRIORITY["location"])
    one = F.struct(
        (F.col("s") - F.col("c")).cast("int").alias("start"), (F.col("e") - F.col("c")).cast("int").alias("end"), pick(1).alias("entity_type"),
        F.col("whole").alias("value"), pick(2).alias("category"), pick(2).alias("source"), priority.cast("int").alias("priority"), pick(3).cast("int").alias("emission"),
    )
    return starting.groupBy(*PLACE).agg(F.collect_list(one).alias("__ner"))


def _resolved_over_seams(found: DataFrame) -> DataFrame:
    """``sel`` per chunk where islands may join chunks (columns: chunk rows with ``cands``, offsets of the chunk)."""
    ends = found.where(F.size("cands") > 0).select(
        *PLACE, START, (F.col(START) + F.array_min(F.transform("cands", lambda c: c["start"]))).alias("first"), (F.col(START) + F.array_max(F.transform("cands", lambda c: c["end"]))).alias("last")
    )
    joined = running(ends, [ROW], "last", "carry", "max").withColumn("begins", (F.col("carry") <= F.col("first")).cast("long"))
    numbered = running(joined, [ROW], "begins", "earlier").withColumn("island", F.col("earlier") + F.col("begins"))
    several = numbered.groupBy(ROW, "island").agg(F.count("*").alias("k"), F.min(START).alias("base")).where("k > 1")
    members = settled(numbered.join(several, [ROW, "island"]).select(*PLACE, "island", "base"))
    alone = found.join(members.select(*PLACE), PLACE, "left_anti").withColumn("sel", F.expr(resolve_sql("cands")))
    together = found.select(*PLACE, START, "cands").join(members, PLACE)
    shift = F.transform(
        "cands",
        lambda c: F.struct(
            (c["start"] + F.col(START) - F.col("base")).cast("int").alias("start"), (c["end"] + F.col(START) - F.col("base")).cast("int").alias("end"),
            *(c[x].alias(x) for x in ("entity_type", "value", "category", "source", "priority", "emission")), F.col(BLOCK_COL).alias(BLOCK_COL), F.col(IDX).alias(IDX), (F.col(START) - F.col("base")).alias("__at"),
        ),
    )
    whole = together.select(ROW, "island", shift.alias("c")).groupBy(ROW, "island").agg(F.flatten(F.collect_list("c")).alias("c"))
    kept = whole.select(ROW, F.explode(F.expr(resolve_sql("c"))).alias("m")).select(
        ROW, F.col(f"m.{BLOCK_COL}").alias(BLOCK_COL), F.col(f"m.{IDX}").alias(IDX),
        F.struct((F.col("m.start") - F.col("m.__at")).cast("int").alias("start"), (F.col("m.end") - F.col("m.__at")).cast("int").alias("end"), *(F.col(f"m.{x}").alias(x) for x in ("entity_type", "value", "category", "source", "priority", "emission"))).alias("m"),
    )
    picked = kept.groupBy(*PLACE).agg(F.sort_array(F.collect_list("m")).alias("sel"))
    over = found.join(members.select(*PLACE), PLACE, "left_semi").join(picked, PLACE, "left").withColumn("sel", F.coalesce("sel", F.expr(empty(CAND_TYPE))))
    return alone.withColumn("sel", F.expr(f"CAST(sel AS {CAND_TYPE})")).unionByName(over.withColumn("sel", F.expr(f"CAST(sel AS {CAND_TYPE})")))


def redact_chunks(pieces: DataFrame, keys, config: RedactionConfig | None = None, ner: DataFrame | None = None, with_vault: bool = False) -> DataFrame:
    """Redacted chunks of texts that ``chunks`` (or ``sources.ranges``) has cut.

    keys, ``row, block, idx``, ``redacted_text`` (the chunk's), ``highlights``, and with
    ``with_vault`` also ``original_text`` and ``replacements``; offsets and token
    numbers are the whole text's.  A replaced span over several chunks is with the
    chunk where it starts; the others lose their share of it.
    """
    ks = [keys] if isinstance(keys, str) else list(keys)
    config = config or RedactionConfig()
    sized = pieces.withColumn(N, F.coalesce(F.length(TEXT), F.lit(0)).cast("long"))
    if ner is None:  # no text goes with the hits: what follows moves numbers, and the values of the hits
        found = with_candidates(sized, TEXT, config, out_col="cands").select(*ks, *PLACE, N, F.expr(resolve_sql("cands")).alias("sel"), F.col(TEXT).isNull().alias("__void"))
        resolved = running(settled(found), [ROW], N, START).withColumn("covered", F.lit(0).cast("long"))
    else:
        found = with_candidates(sized.withColumn("__none", F.expr(empty(NER_TYPE))), TEXT, config, ner_col="__none", out_col="cands").drop("__none")
        own = settled(running(found, [ROW], N, START))
        spans = _model_spans(own, ner, ks, config)
        value = f"transform(__ner, c_ -> named_struct('start', c_.start, 'end', c_.`end`, 'entity_type', c_.entity_type, 'value', coalesce(c_.value, substring({TEXT}, c_.start + 1, c_.`end` - c_.start)), 'category', c_.category, 'source', c_.source, 'priority', c_.priority, 'emission', c_.emission))"
        found = own.join(spans, PLACE, "left").withColumn("cands", F.expr(f"IF(cands IS NULL, NULL, concat(cands, CAST(coalesce({value}, array()) AS {CAND_TYPE})))")).select(*ks, *PLACE, N, START, "cands", F.col(TEXT).isNull().alias("__void"))
        chosen = settled(_resolved_over_seams(settled(found.withColumn("cands", F.coalesce("cands", F.expr(empty(CAND_TYPE)))))))
        ends = chosen.withColumn("__last", F.when(F.size("sel") > 0, F.col(START) + F.element_at("sel", -1)["end"]).otherwise(F.lit(0).cast("long")))
        resolved = running(ends, [ROW], "__last", "covered", "max").drop("__last")
    # what an earlier chunk's span covers is gone from this chunk
    resolved = resolved.withColumn("gone", F.expr("CAST(least(greatest(covered - start, 0), n_chars) AS INT)"))
    moved = "transform(sel, m_ -> named_struct('start', m_.start - gone, 'end', m_.`end` - gone, 'entity_type', m_.entity_type, 'value', m_.value, 'category', m_.category, 'source', m_.source))"
    hits = settled(resolved.select(*ks, *PLACE, N, START, "gone", F.expr(f"IF(__void, NULL, {moved})").alias("sel")))

    prefixes = hits.where(F.size("sel") > 0).select(*PLACE, F.explode("sel").alias("m")).select(*PLACE, F.expr(token_prefix_sql("m.entity_type")).alias("p"))
    numbered = running(prefixes.groupBy(*PLACE, "p").agg(F.count("*").alias("k")), [ROW, "p"], "k", "before")
    given = numbered.groupBy(*PLACE).agg(F.collect_list(F.struct("p", F.col("before").cast("int").alias("n"))).alias("given"))  # a chunk's token prefixes
    records = hits.join(given, PLACE, "left").withColumn("work", F.expr(work_sql("sel", "coalesce(given, array())")))
    # a redacted chunk is as long as what is left of the chunk and what its tokens add, but for what a span takes from later chunks
    last = "try_element_at(work, -1)"
    length = f"IF(size(work) > 0, {last}.output_end + greatest(n_chars - gone - {last}.original_end, 0), n_chars - gone)"
    written = settled(records.select(*ks, *PLACE, (F.col(START) + F.col("gone")).alias("base"), "gone", "work", F.expr(length).cast("long").alias("__n")))
    out = running(written, [ROW], "__n", "__out")
    at = lambda r: F.struct(
        (r["original_start"] + F.col("base")).alias("original_start"), (r["original_end"] + F.col("base")).alias("original_end"),
        (r["output_start"] + F.col("__out")).alias("output_start"), (r["output_end"] + F.col("__out")).alias("output_end"),
        r["token"].alias("token"), r["original_value"].alias("original_value"), r["entity_type"].alias("entity_type"), r["category"].alias("category"),
    )
    # the texts come back by their place: a row each, as the grouping tells Spark, which leaves the join out where no text is read
    texts = pieces.groupBy(*PLACE).agg(F.first(TEXT).alias("original_text"))
    whole = out.join(texts, PLACE, "left").withColumn("rest", F.expr("substring(original_text, gone + 1)"))
    return _chunk_columns(whole.withColumn("replacements", F.transform("work", at)).withColumn("redacted_text", F.expr(redacted_text_sql("rest", "work"))), ks, with_vault)


def _chunk_columns(out: DataFrame, ks: list[str], with_vault: bool) -> DataFrame:
    """What ``redact_chunks`` returns, from rows of chunks with their text, redacted text and replacements."""
    out = out.withColumn("replacements", F.col("replacements").cast(REPLACEMENT))
    highlights = F.transform("replacements", lambda r: F.struct(*(r[x].alias(x) for x in ("output_start", "output_end", "token", "entity_type", "category"))))
    columns = [*ks, *PLACE, "redacted_text", highlights.alias("highlights")]
    return out.select(*columns, *(["original_text", "replacements"] if with_vault else []))


def _redact_together(rows: DataFrame, ks: list[str], config: RedactionConfig, ner: DataFrame | None, with_vault: bool) -> DataFrame:
    """``redact_chunks`` of texts whose chunks are one row each, with the chunks' ends.

    No hit of a rule crosses a seam, so the row's text is searched at once; spans of the
    model are resolved beside the hits, over its seams and inside its chunks.  A chunk
    begins in the redacted text behind the last replacement that begins before it, and
    as far on as the chunk does in the text.
    """
    if ner is None:
        found = with_candidates(rows, TEXT, config, out_col="cands")
    else:
        spans = _usable_spans(ner, ks, config).where(F.col("end") <= TOGETHER_CHARS)
        by_key = spans.groupBy(*ks).agg(F.collect_set(F.struct("start", "end", "label")).alias("__ner"))
        found = with_candidates(rows.join(by_key, ks, "left"), TEXT, config, ner_col="__ner", out_col="cands").drop("__ner")
    work = found.withColumn("sel", F.expr(resolve_sql("cands"))).withColumn("work", F.expr(work_sql("sel")))
    redacted = work.withColumn("redacted", F.expr(redacted_text_sql(TEXT, "work"))).withColumn("reps", F.expr(replacements_sql("work")))
    written = settled(redacted.select(*ks, ROW, TEXT, ENDS, "redacted", "reps"))

    last = "try_element_at(filter(reps, r_ -> r_.original_start < a_), -1)"
    begin = let(last, "l_", "coalesce(l_.output_end + greatest(a_ - l_.original_end, 0), a_)")
    places = written.withColumn("starts", F.expr(f"concat(array(0), {ENDS})")).withColumn("outs", F.expr(f"transform(starts, a_ -> {begin})"))
    each = places.withColumn(IDX, F.explode(F.expr(f"sequence(0L, size({ENDS}) - 1L)"))).withColumn("i", F.col(IDX).cast("int"))
    share = "substring({0}, get({1}, i) + 1, get({1}, i + 1) - get({1}, i))"
    out = each.withColumns({
        BLOCK_COL: F.lit(0).cast("long"),
        "original_text": F.expr(share.format(TEXT, "starts")),
        "redacted_text": F.expr(share.format("redacted", "outs")),
        "replacements": F.expr("filter(reps, r_ -> r_.original_start >= get(starts, i) AND r_.original_start < get(starts, i + 1))"),
    })
    return _chunk_columns(out, ks, with_vault)


def redact_long(df: DataFrame, keys, text: str, config: RedactionConfig | None = None, normalize: str = "nfkc", ner: DataFrame | None = None, with_vault: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``redact_chunks`` of a table's texts."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    config = config or RedactionConfig()
    pieces = settled(_cut(df, ks, text, config, normalize, chunk_chars, TOGETHER_CHARS))
    together = _redact_together(pieces.where(f"{ENDS} IS NOT NULL").select(*ks, ROW, TEXT, ENDS), ks, config, ner, with_vault)
    longer = pieces.where(f"{ENDS} IS NULL").drop(ENDS)
    if longer.isEmpty():
        return together
    return together.unionByName(redact_chunks(settled(normalized(longer, normalize)), ks, config, ner, with_vault))


def vault(redacted_chunks: DataFrame, keys) -> DataFrame:
    """The token table of ``redact_chunks(..., with_vault=True)``; offsets as longs."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    names = ("token", "original_value", "entity_type", "category", "original_start", "original_end", "output_start", "output_end")
    return redacted_chunks.select(*ks, F.explode("replacements").alias("r")).select(*ks, *(f"r.{n}" for n in names))


def assembled(redacted_chunks: DataFrame, keys, column: str = "redacted_text") -> DataFrame:
    """keys, ``row`` and the chunks' texts put together, for texts that fit into one value."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    whole = F.sort_array(F.collect_list(F.struct(BLOCK_COL, IDX, F.col(column).alias("t"))))
    grouped = redacted_chunks.groupBy(ROW, *ks).agg(whole.alias("w"))
    return grouped.select(*ks, ROW, F.when(F.element_at("w", 1)["t"].isNotNull(), F.array_join(F.transform("w", lambda x: x["t"]), "")).alias(column))
