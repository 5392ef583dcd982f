"""Structured Streaming forms (re-aim of the per-click redaction, SURVEY 2.11).

Detection, resolution and rewriting are a stateless projection, so a
streaming DataFrame goes through ``api.redact`` unchanged (append mode, no
state).  Running counts per token prefix use event-time windows with a
watermark, so their state is bounded.  ``write_redacted_and_vault`` writes
the redacted rows and (optionally) the vault rows of every micro-batch in one
``foreachBatch``; each batch overwrites its own (stream, batch) partition, so a
replayed batch replaces its output, and a stream with a new checkpoint, or a
second one, never touches what another wrote.  A batch is listed in a manifest after
both of its writes: ``read_committed`` shows rows and vault of listed batches only, so
never one without the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig


def redact_stream(sdf: DataFrame, keys, text: str, config: RedactionConfig | None = None, with_vault: bool = False) -> DataFrame:
    """Streaming redaction: same columns as ``api.redact``."""
    return api.redact(sdf, keys, text, config, with_vault=with_vault)


def windowed_type_counts(
    sdf: DataFrame,
    keys: Sequence[str],
    text: str,
    event_time: str,
    window: str = "10 minutes",
    watermark: str = "30 minutes",
    config: RedactionConfig | None = None,
) -> DataFrame:
    """Counts per (event-time window, entity type) of selected findings.

    ``event_time`` must be one of ``keys`` so that it is carried through the scan.
    """
    found = api.scan(sdf, list(keys), text, config)
    return (
        found.withWatermark(event_time, watermark)
        .groupBy(F.window(event_time, window).alias("window"), "entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _stream_id(spark: SparkSession, checkpoint_path: str) -> str:
    """The stream's name, kept beside its checkpoint: as long as that lives, batch
    numbers go on; a new checkpoint counts from 0 under a new name."""
    path = f"{checkpoint_path.rstrip('/')}/shroud_stream_id"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(path)
    return name


def commits_path(out_path: str) -> str:
    """Where the batches of ``out_path`` are listed; a name that readers of the rows skip."""
    return f"{out_path.rstrip('/')}/_shroud_commits"


def read_committed(spark: SparkSession, out_path: str, vault_path: str | None = None) -> DataFrame:
    """The redacted rows (or the vault rows, with ``vault_path``) of the batches that were wholly written."""
    rows = spark.read.parquet(vault_path or out_path)
    try:
        listed = spark.read.parquet(commits_path(out_path)).select("stream_id", "batch_id").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows.limit(0)
    return rows.join(listed, ["stream_id", "batch_id"], "left_semi")


def write_redacted_and_vault(
    redacted_with_vault: DataFrame,
    keys: Sequence[str],
    out_path: str,
    checkpoint_path: str,
    vault_path: str | None = None,
    trigger: dict | None = None,
):
    """Start a query writing redacted rows (and vault rows) per micro-batch, idempotently."""
    keys = list(keys)
    stream_id = _stream_id(redacted_with_vault.sparkSession, checkpoint_path)

    def put(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "batch_id").parquet(path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("stream_id", F.lit(stream_id)).withColumn("batch_id", F.lit(batch_id))
        if vault_path is not None:
            stamped = stamped.persist()  # written twice, computed once
        try:
            put(stamped.drop("original_text", "replacements", "token_to_original"), out_path)
            if vault_path is not None:
                put(api.vault(stamped, keys + ["stream_id", "batch_id"]), vault_path)
            session = batch.sparkSession
            put(session.createDataFrame([(True, stream_id, batch_id)], "committed boolean, stream_id string, batch_id long"), commits_path(out_path))  # last
        finally:
            if vault_path is not None:
                stamped.unpersist()

    w = redacted_with_vault.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
