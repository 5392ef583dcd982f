"""Statistics over redaction output.

Per-row values (status line, sizes) are projections.  Corpus-level counts are
one aggregation with map-side partial counts, so only (group, count) pairs
cross the shuffle; a hot group (one language holding a third of the rows)
costs one partial count per task, never a gathered list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.functions import rules as R
from shroud.functions.spans import ident, let, lit


def _label_map_sql() -> str:
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in R.STATUS_LABELS.items())
    return f"map({pairs})"


def status_sql(counts_by_type: str) -> str:
    """"n label, ... redacted" (labels summed, sorted) or "No redactions found" (A4)."""
    labeled = (
        f"transform(map_entries(coalesce({counts_by_type}, CAST(map() AS MAP<STRING, INT>))), "
        f"e_ -> named_struct('label', coalesce(try_element_at({_label_map_sql()}, e_.key), lower(e_.key)), 'n', e_.value))"
    )
    parts = (
        "transform(array_sort(array_distinct(transform(xs_, x_ -> x_.label))), l_ -> concat("
        "CAST(aggregate(filter(xs_, x_ -> x_.label = l_), 0L, (a_, x_) -> a_ + x_.n) AS STRING), ' ', l_))"
    )
    body = let(parts, "ps_", "IF(size(ps_) = 0, 'No redactions found', concat(array_join(ps_, ', '), ' redacted'))")
    return let(labeled, "xs_", body)


def status_column(counts_by_type: str = "counts_by_type") -> Column:
    return F.expr(status_sql(ident(counts_by_type)))


def status_line(redacted: DataFrame, keys) -> DataFrame:
    ks = [keys] if isinstance(keys, str) else list(keys)
    return redacted.select(*ks, status_column("counts_by_type").alias("status"))


def input_status(df: DataFrame, keys, text: str) -> DataFrame:
    """Blank-input guard (P3): 'empty' for null or whitespace-only text, else 'ok'.

    Rows are kept either way; a blank text simply has nothing to redact.
    """
    ks = [keys] if isinstance(keys, str) else list(keys)
    blank = F.col(text).isNull() | (F.length(F.regexp_replace(F.col(text), f"[{R.SPACE_SET}]+", "")) == 0)
    return df.select(*ks, F.when(blank, F.lit("empty")).otherwise(F.lit("ok")).alias("input_status"))


WHITESPACE_RUN_FREE = f"[^{R.SPACE_SET}]+"


def text_sizes(df: DataFrame, keys, text: str) -> DataFrame:
    """Characters and whitespace-separated words per row."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    return df.select(
        *ks,
        F.length(text).cast("long").alias("n_chars"),
        F.regexp_count(F.col(text), F.lit(WHITESPACE_RUN_FREE)).cast("long").alias("n_words"),
    )


def type_totals(findings: DataFrame) -> DataFrame:
    """Corpus total per entity type (A3)."""
    return findings.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(findings: DataFrame, docs: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Counts per entity type, rolled up over ``by`` (e.g. lang, source) (A3, scale form).

    Grouping sets (by..., type), (by[0], type), ..., (type).  When ``findings``
    already carries the ``by`` columns (pass them as scan keys) no join is
    needed; otherwise the small per-document attributes are joined on the key.
    ``rolled_up``: a bit for each of (by..., type) that the row sums over, so that a
    null of the data is told from a sum.
    """
    by = list(by)
    f = findings
    if not all(c in findings.columns for c in by):
        f = findings.join(docs.select(key, *by), on=key, how="inner")
    sets = [by[:i] + ["entity_type"] for i in range(len(by), -1, -1)]
    g = f.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by + ["entity_type"]])
    return g.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("rolled_up"))


def breakdown(redacted: DataFrame) -> DataFrame:
    """The statistics panel for a whole table (A3): position, token_prefix, label, n.

    Position 0 is the grand total, then the token prefixes in order, each with
    its capitalised label; no rows at all if nothing was found.
    """
    counts = redacted.select(F.explode_outer("counts_by_type").alias("token_prefix", "n")).where("n IS NOT NULL")
    # one row per token prefix reaches the window: as many as there are rules
    per_prefix = counts.groupBy("token_prefix").agg(F.sum("n").alias("n"))
    label = F.expr(f"coalesce(try_element_at({_label_map_sql()}, token_prefix), lower(token_prefix))")
    rows = per_prefix.rollup("token_prefix").agg(F.sum("n").alias("n"), F.grouping("token_prefix").alias("total")).where("n IS NOT NULL")
    rows = rows.withColumn("label", F.when(F.col("total") == 1, F.lit("total")).otherwise(label)).withColumn("label", F.expr("concat(upper(substring(label, 1, 1)), lower(substring(label, 2)))"))
    order = Window.orderBy(F.desc("total"), "token_prefix")
    return rows.select((F.row_number().over(order) - 1).alias("position"), "token_prefix", "label", "n")
