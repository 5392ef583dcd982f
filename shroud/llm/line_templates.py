"""Line dedup with a log-template tree.

A line's tokens are its stretches without ASCII white space; a token that holds a
digit is a variable field and reads ``<*>`` (unless such tokens are more than
half of the line).  The tree has a fixed depth: token count, then the first
``depth`` tokens.  In a leaf, what remains of the line is parted into four
stretches; a template fixes three of them and generalises the fourth, so lines
of one template agree in count, leading tokens and at least three quarters of
the rest; lines that differ in two words without a digit in different stretches,
or in one of the leading tokens, do not meet.  Every line belongs to four
templates, each a 64-bit key: nothing but keys, ids and positions is shuffled,
and the tree needs no order of arrival.

A template found in two or more documents recurs.  Its lines stay in the
document with the smallest id that has it and are dropped from all others.  Lines
shorter than ``min_tokens`` are never dropped; where it admits lines of fewer than
``depth`` + 4 tokens, such a line's one template is the whole masked line.  A very
common line is pre-aggregated per task, and where it joins back its partition can
be split.

Defined results: null text stays null (no lines); empty lines and repeated rows
stay as they are (rows of one id are one document); rows without an id count as
no further document and lose lines that recur among the others; an empty table
gives an empty result; other columns of the input are kept by
:func:`drop_recurring` and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import columns, cut, let

DEPTH, MIN_TOKENS, STRETCHES = 4, 8, 4


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``doc_id, row_key, pos, keys``: the template keys (four, or one of a short line) of every line that can be dropped."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    lines = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tokens = lines.withColumn("raw", F.filter(F.split("line", r"\s+"), lambda t: t != "")).drop("line").where(F.size("raw") >= max(1, min_tokens))
    masked = tokens.withColumn("masked", F.transform("raw", lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t)))
    fields = F.size(F.filter("masked", lambda t: t == "<*>"))
    line = masked.select("doc_id", "row_key", "pos", F.when(2 * fields <= F.size("raw"), F.col("masked")).otherwise(F.col("raw")).alias("t"))
    whole = [F.when(F.size("t") < depth + STRETCHES, F.xxhash64(F.size("t"), "t")).alias("whole")] if min_tokens < depth + STRETCHES else []
    rest = F.greatest(F.size("t") - depth, F.lit(0))
    start = [F.lit(depth + 1) + F.floor(rest * i / STRETCHES).cast("int") for i in range(STRETCHES + 1)]
    stretches = [F.xxhash64(F.slice("t", start[i], start[i + 1] - start[i])) for i in range(STRETCHES)]
    leaf = F.xxhash64(F.size("t"), F.slice("t", 1, depth))
    hashed = line.select("doc_id", "row_key", "pos", leaf.alias("leaf"), *(s.alias(f"s{i}") for i, s in enumerate(stretches)), *whole)
    keys = F.array(*(F.xxhash64("leaf", F.lit(i), *(f"s{j}" for j in range(STRETCHES) if j != i)) for i in range(STRETCHES)))
    return hashed.select("doc_id", "row_key", "pos", (F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(keys) if whole else keys).alias("keys"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``doc_id, row_key, dropped``: the positions of the lines to drop, where there are any."""
    lines = cut(line_keys(docs, id_col, text_col, depth, min_tokens)).select("doc_id", "row_key", "pos", F.explode("keys").alias("template"))
    spans = lines.groupBy("template").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    recurring = cut(spans.where(F.col("first") < F.col("last")).select("template", "first"))
    hits = lines.join(recurring, "template").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "row_key", "pos")
    return hits.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("dropped"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents with their texts' recurring lines dropped, ``n_lines`` and ``n_dropped`` beside them in a struct ``line_dedup``."""
    found = recurring_lines(docs, id_col, text_col, depth, min_tokens)
    drops = found.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"), F.col("dropped").alias("__dropped"))
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["__id"]) & (F.xxhash64(docs[id_col], docs[text_col]) == drops["__row"]), "left")
    kept = let(
        F.split(text_col, "\n"),
        lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped")), lambda i: F.get(lines, i)), "\n"),
    )
    n_lines = F.when(F.col(text_col).isNotNull(), F.size(F.split(text_col, "\n"))).otherwise(0).cast("long")
    n_dropped = F.coalesce(F.size("__dropped"), F.lit(0)).cast("long")
    n_dropped = F.when(F.col("__dropped").isNull(), F.lit(0).cast("long")).otherwise(n_dropped)
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(kept)
    info = F.struct(n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
    return joined.select(*(text.alias(c) if c == text_col else joined[c] for c in docs.columns), info.alias("line_dedup"))
