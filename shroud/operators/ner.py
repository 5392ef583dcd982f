"""External NER spans (D15, D16, P5): a span table joined by key.

The model runs outside this engine and writes ``(keys..., start, end, label)``.
Spans are coerced (integer offsets, upper-case label, malformed rows dropped),
reduced to one array per key with partial aggregation, and left-joined to the
texts.  Spark broadcasts the reduced table only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold``; otherwise both sides are
shuffled on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NER_COL = "__shroud_ner"


def coerce_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    s = spans.select(
        *keys,
        F.col("start").try_cast("int").alias("start"),
        F.col("end").try_cast("int").alias("end"),
        F.upper(F.col("label").cast("string")).alias("label"),
    )
    return s.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("label").isNotNull())


def attach_ner(base: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    per_key = (
        coerce_spans(spans, keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias(NER_COL))
    )
    return base.join(per_key, on=keys, how="left")
