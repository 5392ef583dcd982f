"""Rows with very many hits, overlap islands, and the plans of the per-row kernel."""

import model
import pytest
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tail", ["", " 4242 4242 4242 4242", " \ue000 mark"])
def test_thousands_of_hits_in_one_row(redact_one, tail):
    overlapping = "; 4242 4242 4242 4242 at 10.0.0.1, Dana Fox 12 Elm Street 987-65-4320"
    text = " ".join(f"w{i}@m{i % 7}.io" + (overlapping if i % 100 == 0 else "") for i in range(2500)) + tail
    row = redact_one([text])[0]
    want, reps = model.redact(text)
    assert row.redacted_text == want
    assert [tuple(r) for r in row.replacements] == [tuple(r) for r in reps]


def test_candidates_keep_the_first_of_equal_spans_in_order(spark):
    df = spark.createDataFrame([(1, "zeta Alpha beta alpha")], "id long, text string")
    cfg = RedactionConfig(custom_regex=["alpha", "zeta"], custom_keywords=["ALPHA", "beta"])
    rows = api.candidates(df, "id", "text", cfg).collect()
    assert [(r.start, r.value) for r in rows] == [(5, "Alpha"), (16, "alpha"), (0, "zeta"), (11, "beta")]


def test_key_filters_after_redaction_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (api.scan(docs, ["doc_id", "lang"], "text"), api.redact(docs, ["doc_id", "lang"], "text")):
        plan = _physical(df.where("doc_id = 5"))
        assert "EqualTo(doc_id,5)" in plan.split("PushedFilters:")[1]
        assert "source" not in plan.split("ReadSchema:")[1]


def test_each_rule_is_evaluated_once(spark):
    once = _plan(Q.redacted_text(spark, SF)).count("AKIA[0-9A-Z]{16}")
    for name in ("counts_by_type", "counts_by_category", "findings_resolved", "candidates_all", "status_summary", "replacement_offsets"):
        assert _plan(Q.QUERIES[name](spark, SF)).count("AKIA[0-9A-Z]{16}") == once, name


def test_bytes_that_are_not_utf8_do_not_stop_the_job(spark):
    df = spark.range(2).select("id", F.expr("CAST(unhex(IF(id = 0, 'FFC3', 'EFBC91')) AS STRING)").alias("text"))
    got = {r.id: r.n for r in api.redact(df, "id", "text").select("id", F.hex("redacted_text").alias("n")).collect()}
    assert got == {0: "EFBFBDEFBFBD", 1: "31"}


def test_row_toggles_and_keywords(spark):
    df = spark.createDataFrame(
        [(1, "a@b.io or c.*d", {"emails": False}, ["c.*d", r"\\E("]), (2, "a@b.io or c.*d", None, None), (3, r"x \\E( y c.*d", {"custom": True}, [r"y", "", None])],
        "id long, text string, own map<string,boolean>, words array<string>",
    )
    got = {r.id: r.redacted_text for r in api.redact(df, "id", "text", row_toggles="own", row_keywords="words").collect()}
    assert got == {1: "a@b.io or [CUSTOM_1]", 2: "[EMAIL_1] or c.*d", 3: r"x \\E( [CUSTOM_1] c.*d"}
