"""Every stage on awkward rows and on its own input against brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shroud.llm import queries
from tests.llm import brute
from tests.llm.test_contracts import AWKWARD, SCHEMA, check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_names_and_run(spark, given):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxicity_drops_what_the_operator_calls_toxic(spark, given):
    toxic = {r.doc_id for r in queries.op6_kn_toxicity(spark, SF).where("predicted = 1").collect()}
    out = corpus_pipeline.toxicity(spark, given, SF)
    assert out.columns == given.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in given.collect()} - toxic


def test_line_dedup_and_near_dedup(spark, given):
    rows = given.collect()
    out = corpus_pipeline.line_dedup(spark, given, SF)
    want = {d: t for d, _, _, t in brute.line_templates([(r.doc_id, r.text) for r in rows])}
    assert {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())
    roots = brute.components([(d, brute.fingerprint(t)) for d, t in want.items()])
    kept = corpus_pipeline.near_dedup(spark, out, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values())) and kept.columns == given.columns


def test_mixing_repeats_documents_as_often_as_the_mix_takes_them(spark, given):
    mixed = corpus_pipeline.mixing(spark, given, SF)
    taken = {r.doc_id: (r.taken, r.size) for r in queries.op4_pareto_mix(spark, SF).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(got.get(d, 0) * size == t for d, (t, size) in taken.items() if size) and mixed.columns == given.columns


def test_stages_on_awkward_and_on_no_rows(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).withColumn("keys", F.lit(1))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name != "packing":
                assert out.columns == rows.columns
            out.collect()
    mixed = corpus_pipeline.mixing(spark, docs, SF).where("doc_id = 1").count()
    assert mixed % 2 == 0 and mixed <= 6
    check_packing(corpus_pipeline.packing(spark, docs, SF).collect(), AWKWARD, queries.tokenizer("byte_bpe_50k.json"))
