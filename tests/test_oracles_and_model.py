"""Registered queries vs their DuckDB oracles, and Spark vs the Python model."""

from collections import Counter

import duckdb
import model
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from shroud import api
from shroud.plans.planted import QUERIES as PLANTED

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations benchmark events orders".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize(
    "name",
    ["email_findings", "person_findings", "card_findings", "findings_resolved", "redacted_text",
     "replacement_offsets", "status_summary", "corpus_stats", "keyword_findings", "custom_regex_findings", "stream_vault", *PLANTED],
)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    assert name not in PLANTED or len(rel) > 0
    assert sorted(df.columns) == sorted(rel.columns)
    srows = [tuple(r) for r in df.collect()]
    assert _rows(df.columns, srows) == _rows(rel.columns, rel.fetchall())


def test_every_query_has_an_oracle():
    from shroud.plans.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "redacted_text", "highlights", "counts_by_type", "counts_by_category"]


def test_documents_match_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    src = {r.doc_id: r.text for r in docs.collect()}
    for r in api.redact(docs, "doc_id", "text", with_vault=True).collect():
        text, reps = model.redact(src[r.doc_id])
        assert r.redacted_text == text
        assert [tuple(x) for x in r.replacements] == [tuple(x) for x in reps]


FRAGMENTS = ["a@b.io", "Bob Stone", "10.0.0.1", "202-555-0111", "4242 4242 4242 4242", "123-45-6789",
             "sk-abcdefghijklmnopqrstuvwxyz", "12 Main St", "DOB: 01/02/1990", "x", " ", "-", ".", "😀", "AB12345678"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS), max_size=12).map("".join), min_size=1, max_size=8))
def test_random_texts_match_model(redact_one, texts):
    got = redact_one(texts)
    for i, t in enumerate(texts):
        want_text, want_reps = model.redact(t)
        assert got[i].redacted_text == want_text, t
        assert [tuple(x) for x in got[i].replacements] == [tuple(x) for x in want_reps], t
