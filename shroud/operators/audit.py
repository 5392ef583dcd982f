"""Audit of token-like literals in the input.

A text that already reads ``[EMAIL_1]`` is restored wrongly if the row's own redaction
gives out that token: restore cannot tell the literal from the token.  The literals are
found by the token grammar in the normalised text and held against the tokens that the
row was given.  A projection; only rows with a literal pay for more than one search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud import api
from shroud.functions.spans import find_all_sql, let
from shroud.operators.redact import TOKEN_RE


def _fails_sql(literal: str) -> str:
    """Whether restoring breaks at the literal.

    It does where the row gives out the token, unless a hit that overlaps the literal
    is put back at the token's turn or after it: the literal only shows from then on.
    """
    mine = f"filter(transform(replacements, (r_, i_) -> named_struct('k', -length(r_.token), 'i', i_, 't', r_.token)), t_ -> t_.t = {literal}.value)"
    over = f"filter(transform(replacements, (r_, i_) -> named_struct('k', -length(r_.token), 'i', i_, 's', r_.original_start, 'e', r_.original_end)), o_ -> o_.s < {literal}.`end` AND {literal}.start < o_.e)"
    earlier = "forall(ov_, o_ -> o_.k < get(mine_, 0).k OR (o_.k = get(mine_, 0).k AND o_.i < get(mine_, 0).i))"
    return let(mine, "mine_", f"(size(mine_) > 0 AND {let(over, 'ov_', earlier)})")


def literal_tokens(df: DataFrame, keys, text: str, config=None, normalize: str = "nfkc", ner=None) -> DataFrame:
    """keys, start, end, literal, assigned, fails: every token-like literal of the input texts.

    ``assigned``: the row's redaction gives out this token; ``fails``: the row's round
    trip breaks at the literal.  A row fails ``evaluate.roundtrip_failures`` exactly if
    one of its literals does.
    """
    ks = [keys] if isinstance(keys, str) else list(keys)
    red = api.redact(df, ks, text, config, normalize, ner, with_vault=True).select(*ks, "original_text", "replacements")
    found = red.withColumn("__l", F.expr(find_all_sql("original_text", TOKEN_RE, needs=("[",)))).where(F.size("__l") > 0)
    each = found.select(*ks, "replacements", F.explode("__l").alias("l"))
    assigned = F.exists("replacements", lambda r: r["token"] == F.col("l.value"))
    return each.select(*ks, "l.start", "l.end", F.col("l.value").alias("literal"), assigned.alias("assigned"), F.expr(_fails_sql("l")).alias("fails"))
