"""Public DataFrame API.

Every function takes a DataFrame with key column(s) and a text column and
returns a DataFrame.  Detection, resolution and rewriting are one narrow
projection (no shuffle), so they run unchanged on a streaming DataFrame.

* ``candidates``  - every detector hit before resolution (one row per hit)
* ``scan``        - selected findings after overlap resolution (one row per hit)
* ``redact``      - redacted text + counts per row; values only with ``with_vault``
* ``vault``       - the token -> value table (opt-in, store it separately)
* ``restore``     - put values back into redacted or edited texts (join on key)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.config import RedactionConfig
from shroud.functions.normalize import normalize_column
from shroud.functions.spans import empty, ident
from shroud.operators.detect import (
    CAND_TYPE,
    as_matches_sql,
    dedupe_candidates_sql,
    row_keyword_candidates_sql,
    row_toggle_filter_sql,
    row_toggle_sql,
    with_candidates,
)
from shroud.operators.redact import REPLACEMENT_TYPE, count_map_sql, redacted_text_sql, replacements_sql, restore_sql, token_prefix_sql, token_to_original_sql, work_sql
from shroud.operators.resolve import resolve_sql

NORM = "__shroud_text"
CANDS = "__shroud_cands"
TOGGLES = "__shroud_toggles"
KEYWORDS = "__shroud_keywords"
SEL = "__shroud_sel"
WORK = "__shroud_work"


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


SCAN_PARTITIONS = "shroud.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition, if the session asks for it.

    Detection costs far more per byte than reading.  Where the input has too few
    splits (one large row group, say), set ``shroud.scan.partitions``; unset,
    the input's own splits are used and nothing is shuffled.
    """
    wanted = None if df.isStreaming else df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def evened(df: DataFrame) -> DataFrame:
    """The rows over tasks of like size, which adaptive execution takes from the bytes (streams: as many as shuffles have).

    For inputs whose files or row groups are large or uneven, before work that costs far more than a shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if df.isStreaming else df.hint("rebalance")


def prepared(
    df: DataFrame,
    keys: str | Sequence[str],
    text: str,
    config: RedactionConfig | None = None,
    normalize: str = "nfkc",
    ner: DataFrame | None = None,
    row_toggles: str | None = None,
    row_keywords: str | None = None,
) -> DataFrame:
    """keys, normalised text and the candidate array (internal building block).

    ``row_toggles``: a ``map<string, boolean>`` column of switches for its own row
    (what ``config`` switches off stays off; null map or absent switch: default).
    ``row_keywords``: an ``array<string>`` column of keywords for its own row
    (null and empty words are skipped).

    ``ner``: optional span table ``(keys..., start, end, label)`` from an
    external model; it is collected per key and left-joined (D15, D16).
    """
    config = config or RedactionConfig()
    ks = _keys(keys)
    own = {c: F.col(name) for c, name in ((TOGGLES, row_toggles), (KEYWORDS, row_keywords)) if name}
    base = spread(df.select(*[F.col(k) for k in ks], F.col(text).alias(NORM + "_raw"), *(col.alias(c) for c, col in own.items())))
    base = normalize_column(base, NORM + "_raw", NORM, normalize)
    base = base.drop(NORM + "_raw")
    ner_col = None
    if ner is not None:
        from shroud.operators.ner import attach_ner

        base = attach_ner(base, ner, ks)
        ner_col = "__shroud_ner"
    out = with_candidates(base, NORM, config, ner_col=ner_col, out_col=CANDS)
    if row_keywords and config.enabled("custom"):
        # keywords that the row's own switch would take out again are not searched
        words = f"IF({row_toggle_sql(ident(TOGGLES), 'custom')}, {ident(KEYWORDS)}, NULL)" if row_toggles else ident(KEYWORDS)
        more = row_keyword_candidates_sql(ident(NORM), words, config)
        out = out.withColumn(CANDS, F.expr(f"concat({ident(CANDS)}, coalesce({more}, {empty(CAND_TYPE)}))"))
    if row_toggles:
        out = out.withColumn(CANDS, F.expr(row_toggle_filter_sql(ident(CANDS), ident(TOGGLES))))
    return out.select(*ks, NORM, CANDS)


def candidates(df, keys, text, config=None, normalize="nfkc", ner=None, row_toggles=None, row_keywords=None) -> DataFrame:
    """One row per detector hit before resolution (after D17/D18 de-duplication)."""
    ks = _keys(keys)
    p = prepared(df, ks, text, config, normalize, ner, row_toggles, row_keywords)
    p = p.select(*ks, F.explode_outer(F.expr(as_matches_sql(dedupe_candidates_sql(ident(CANDS))))).alias("m"))
    return p.where(F.col("m").isNotNull()).select(*ks, "m.*")


def with_selection(df, keys, text, config=None, normalize="nfkc", ner=None, row_toggles=None, row_keywords=None) -> DataFrame:
    """keys, normalised text, selected matches (internal)."""
    ks = _keys(keys)
    p = prepared(df, ks, text, config, normalize, ner, row_toggles, row_keywords)
    return p.select(*ks, NORM, F.expr(resolve_sql(ident(CANDS))).alias(SEL))


def scan(df, keys, text, config=None, normalize="nfkc", ner=None, row_toggles=None, row_keywords=None) -> DataFrame:
    """One row per selected match: keys, start, end, entity_type, value, category, source."""
    ks = _keys(keys)
    s = with_selection(df, ks, text, config, normalize, ner, row_toggles, row_keywords)
    s = s.select(*ks, F.explode_outer(F.expr(as_matches_sql(ident(SEL)))).alias("m"))
    return s.where(F.col("m").isNotNull()).select(*ks, "m.*")


def redact(
    df,
    keys,
    text,
    config=None,
    normalize="nfkc",
    ner=None,
    with_vault: bool = False,
    row_toggles=None,
    row_keywords=None,
) -> DataFrame:
    """One row per input row.

    Default columns: keys, redacted_text, highlights (output offsets, token,
    type, category - no values), counts_by_type, counts_by_category.
    ``with_vault=True`` adds original_text (normalised), replacements (with
    values) and token_to_original - keep that output out of shared storage.
    """
    ks = _keys(keys)
    s = with_selection(df, ks, text, config, normalize, ner, row_toggles, row_keywords)
    # each column by itself, from the records or the selection: Spark leaves out what a query does not read
    s = s.select(*ks, NORM, SEL, F.expr(work_sql(ident(SEL))).alias(WORK))
    cols = [
        *ks,
        F.expr(redacted_text_sql(ident(NORM), ident(WORK))).alias("redacted_text"),
        F.expr(
            f"transform({ident(WORK)}, h_ -> named_struct('output_start', h_.output_start, "
            "'output_end', h_.output_end, 'token', h_.token, 'entity_type', h_.entity_type, 'category', h_.category))"
        ).alias("highlights"),
        F.expr(count_map_sql(f"transform({ident(SEL)}, m_ -> {token_prefix_sql('m_.entity_type')})")).alias("counts_by_type"),
        F.expr(count_map_sql(f"transform({ident(SEL)}, m_ -> m_.category)")).alias("counts_by_category"),
    ]
    if with_vault:
        cols += [
            F.col(NORM).alias("original_text"),
            F.expr(replacements_sql(ident(WORK))).alias("replacements"),
            F.expr(token_to_original_sql(ident(WORK))).alias("token_to_original"),
        ]
    return s.select(*cols)


def counts(df, keys, text, config=None, by: str = "token_prefix", normalize="nfkc", ner=None) -> DataFrame:
    """keys, ``by``, n: selected findings per token prefix (A1) or ``by="category"`` (A2) of each row; nothing is rewritten."""
    ks = _keys(keys)
    name = {"token_prefix": token_prefix_sql("m_.entity_type"), "category": "m_.category"}[by]
    s = with_selection(df, ks, text, config, normalize, ner)
    found = s.select(*ks, F.explode(F.expr(count_map_sql(f"transform({ident(SEL)}, m_ -> {name})"))).alias(by, "n"))
    return found.withColumn("n", F.col("n").cast("long"))


def vault(redacted: DataFrame, keys) -> DataFrame:
    """Token table from a ``redact(..., with_vault=True)`` result.

    One row per replacement: keys, text_id, token, original_value, entity_type,
    category, original_start, original_end, output_start, output_end.  ``text_id``
    is a hash of the redacted text: it tells rows of one key apart in ``restore``.
    """
    ks = _keys(keys)
    v = redacted.select(*ks, text_id().alias("text_id"), F.explode_outer("replacements").alias("r")).where(F.col("r").isNotNull())
    return v.select(
        *ks,
        "text_id",
        "r.token",
        "r.original_value",
        "r.entity_type",
        "r.category",
        "r.original_start",
        "r.original_end",
        "r.output_start",
        "r.output_end",
    )


def restore_own(redacted: DataFrame, keys, text: str = "redacted_text") -> DataFrame:
    """Restore each row from its own replacements (J1): keys, restored_text."""
    ks = _keys(keys)
    return redacted.select(*ks, F.expr(restore_sql(ident(text), "replacements")).alias("restored_text"))


def text_id(text: str = "redacted_text"):
    """Which redacted text a vault row belongs to."""
    return F.xxhash64(text)


def restore(edited: DataFrame, vault_df: DataFrame, keys, text: str = "redacted_text") -> DataFrame:
    """Restore redacted or edited texts with a vault table.

    The vault is first reduced to one row per key and redacted text, then left-joined;
    both joins are ordinary equi-joins: Spark broadcasts a side only when its
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise
    it shuffles both sides on the key (AQE splits skewed keys).

    ``status`` is ``'restored'``, ``'nothing_to_restore'`` (no vault row of the key; the
    text stays) or ``'ambiguous_key'``: rows of different texts share the key and the
    text is none of them unchanged, or rows of equal redacted text have different
    values.  An ambiguous text stays as it is: no value lands in another row's text.
    """
    ks = _keys(keys)
    names = ["original_start", "original_end", "output_start", "output_end", "token", "original_value", "entity_type", "category"]
    own = vault_df if "text_id" in vault_df.columns else vault_df.withColumn("text_id", F.lit(0).cast("long"))
    # position order: the order of a collected set is not defined after a shuffle; equal rows count once
    per_text = own.groupBy(*ks, "text_id").agg(F.sort_array(F.collect_set(F.struct(*names))).cast(REPLACEMENT_TYPE).alias("__reps"))
    # from the texts, not from the replacements: the vault is read and grouped by text once, and few rows are left
    per_key = per_text.groupBy(*ks).agg(F.min("text_id").alias("__one"), (F.min("text_id") != F.max("text_id")).alias("__several"))
    marked = edited.select(*ks, F.col(text).alias("__text")).join(per_key, on=ks, how="left")
    marked = marked.withColumn("text_id", F.when(F.col("__several"), text_id("__text")).otherwise(F.col("__one")))
    j = marked.join(per_text, on=[*ks, "text_id"], how="left")
    unclear = F.col("__reps").isNull() | (F.size(F.array_distinct(F.transform("__reps", lambda r: r["token"]))) < F.size("__reps"))
    status = F.when(F.col("__one").isNull(), "nothing_to_restore").when(unclear, "ambiguous_key").otherwise("restored")
    restored = F.when(status == "restored", F.expr(restore_sql("__text", "__reps"))).otherwise(F.col("__text"))
    return j.select(*ks, restored.alias("restored_text"), status.alias("status"))
