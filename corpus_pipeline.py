"""Corpus pipeline: five stages, each one operator over all that the stage before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
each stage's rows as Parquet into the shared folder and reads them back as the
next stage's ``docs``.  All stages but the last return the columns of
``documents``: a text that changed has a new ``n_chars``.  Every stage follows
the defined results of its operator for nulls, empty texts, repeated rows and
empty tables; other columns are carried along.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import bin_packing, kn_toxicity, line_templates, pareto_mix, queries, simhash_bytes
from shroud.llm.common import released
from shroud.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models call toxic go.  The models learn from the documents table's labelled rows."""
    model = queries.toxicity_model(spark, sf_dir, docs)
    others = F.struct(*(c for c in docs.columns if c != "text"))  # one column, whatever their names; the text travels once
    kept = kn_toxicity.harmless(docs.select("doc_id", "text", others.alias("own")), model, ["text", "own"])
    return kept.select(*("text" if c == "text" else F.col("own")[c].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in their first document only."""
    found = line_templates.drop_recurring(docs).drop("line_dedup")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one document stays, that with the smallest id."""
    return simhash_bytes.representatives(docs, shingle=queries.SHINGLE, max_bits=queries.MAX_BITS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = pareto_mix.mix(docs).where("copies > 0").select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size", "occurrence", "copies")))
    # rows of equal id, source and size are numbered alike on both sides; which has which number is open
    rows = docs.withColumn("__row", F.monotonically_increasing_id())  # docs is a table: every reader has the same numbers
    own = pareto_mix.numbered(rows.select("__row", "doc_id", "source", pareto_mix.size_of("text").alias("size")), ("doc_id", "source", "size"))
    same = own["doc_id"].eqNullSafe(taken["__doc_id"]) & own["source"].eqNullSafe(taken["__source"]) & (own["size"] == taken["__size"]) & (own["occurrence"] == taken["__occurrence"])
    chosen = own.join(taken, same).select("__row", F.sequence(F.lit(1), F.col("__copies").cast("int")).alias("__copies"))
    return rows.join(chosen, "__row").withColumn("__copy", F.explode("__copies")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return bin_packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The models, fingerprints and token ids have no SQL form: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, function = stage
        kept = function(spark, docs, sf_dir)
        with released(spark):
            kept.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
