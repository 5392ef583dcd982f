"""Quality jobs.

* ``expected_misses`` / ``recall_report`` - labelled corpus: every expected
  item (``A|B`` = any alternative) must be among the row's token prefixes.
  Relational: explode the expectations, semi/anti join on (key, prefix);
  only distinct (key, prefix) pairs of the findings cross the shuffle.
* ``roundtrip_failures`` - rows whose restore differs from the normalised text.
* ``toggle_leaks`` - findings of switched-off types in a run with a config.
* ``toggled_off`` - findings that a second run with other switches loses.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.functions import rules as R
from shroud.functions.spans import ident
from shroud.operators.redact import restore_sql


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def expected_misses(expected: DataFrame, redacted: DataFrame, keys, expected_col: str = "expected_any") -> DataFrame:
    """keys, item_no, item: expected items with no token of any alternative prefix in the row."""
    ks = _keys(keys)
    items = expected.select(*ks, F.posexplode(expected_col).alias("item_no", "item"))
    alts = items.select(*ks, "item_no", "item", F.explode(F.split("item", r"\|")).alias("prefix"))
    found = redacted.select(*ks, F.explode(F.map_keys("counts_by_type")).alias("prefix")).distinct()
    hit = alts.join(found, on=ks + ["prefix"], how="left_semi").select(*ks, "item_no").distinct()
    return items.join(hit, on=ks + ["item_no"], how="left_anti").select(*ks, "item_no", "item")


def recall_report(expected: DataFrame, redacted: DataFrame, keys, expected_col: str = "expected_any") -> DataFrame:
    """item, expected, found, recall - per expected item (alternatives kept as written)."""
    ks = _keys(keys)
    items = expected.select(*ks, F.posexplode(expected_col).alias("item_no", "item"))
    misses = expected_misses(expected, redacted, ks, expected_col).withColumn("missed", F.lit(1))
    j = items.join(misses.drop("item"), on=ks + ["item_no"], how="left")
    return j.groupBy("item").agg(
        F.count(F.lit(1)).alias("expected"),
        (F.count(F.lit(1)) - F.count("missed")).alias("found"),
    ).withColumn("recall", F.col("found") / F.col("expected"))


def roundtrip_failures(redacted_with_vault: DataFrame, keys) -> DataFrame:
    """Rows where restoring the redacted text does not give back the normalised text (Q1)."""
    ks = _keys(keys)
    both = f"array(named_struct('original_text', original_text, 'restored_text', {restore_sql(ident('redacted_text'), 'replacements')}))"
    # kept by a generator: a filter would be pushed below the redaction, which would then run once for each mention
    differing = f"filter({both}, b_ -> NOT (b_.original_text <=> b_.restored_text))"
    return redacted_with_vault.select(*ks, F.inline(F.expr(differing)))


def toggle_leaks(findings: DataFrame, toggles: dict[str, bool]) -> DataFrame:
    """Findings whose type is switched off by ``toggles`` (Q3) - expected empty."""
    on = dict(R.DEFAULT_TOGGLES)
    on.update(toggles)
    off_types = [
        t for t, switches in R.TOGGLES_BY_TYPE.items() if not all(on.get(k, True) for k in switches)
    ]
    cond = F.col("entity_type").isin(*off_types) if off_types else F.lit(False)
    if not on.get("custom", True):
        cond = cond | (F.col("category") == "custom")
    return findings.where(cond)


def toggled_off(df: DataFrame, keys, text: str, toggles: dict[str, bool], config=None) -> DataFrame:
    """Findings of a run with ``config`` that a second run with ``toggles`` as well does not have (Q3)."""
    ks = _keys(keys)
    base = config or RedactionConfig()
    less = replace(base, enabled_categories={**base.enabled_categories, **toggles})
    place = [*ks, "start", "end", "entity_type"]
    return api.scan(df, ks, text, base).join(api.scan(df, ks, text, less).select(*place), place, "left_anti")
