"""The reviewer's findings of round 4."""

import os

import pytest
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.functions import rules as R
from shroud.functions.spans import MARK, SHORT_BYTES, find_all_sql, lit
from shroud.operators import chunked, redact
from shroud.plans import queries
from shroud.session import ensure_checkpoint_dir
from shroud.sources import ranges

BODY = "mail bob@x.com, call Clara Nowak; or 172.16.8.44! "


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _writes(monkeypatch) -> list[set[str]]:
    """The columns of every frame that is written to the checkpoint folder."""
    written, settled = [], chunked.settled
    monkeypatch.setattr(chunked, "settled", lambda d: written.append(set(d.columns)) or settled(d))
    return written


def test_texts_of_files_are_written_once(spark, tmp_path, monkeypatch):
    """of the steps' rows only the pieces hold texts, and a vault is made without joining them."""
    for i in range(2):
        (tmp_path / f"f{i}.txt").write_text(BODY * 30 + "\n" + "x" * i)
    written = _writes(monkeypatch)
    pieces = ranges.read_text_chunks(spark, str(tmp_path), chunk_chars=20)
    assert "strategy=broadcast" in _plan(pieces)
    red = chunked.redact_chunks(pieces, "path", with_vault=True)
    assert [columns & {"piece", "rest", "redacted_text", chunked.TEXT} for columns in written] == [set(), {"piece"}, set(), set(), set()]
    found = chunked.vault(red, "path")
    assert "first(" in _plan(red) and "first(" not in _plan(found) and chunked.TEXT not in _plan(found)
    for f in tmp_path.iterdir():  # nothing reads the files again
        f.unlink()
    texts = {r.path[-6:]: r.redacted_text for r in chunked.assembled(red, "path").collect()}
    body = "".join(f"mail [EMAIL_{i}], call [PERSON_{i}]; or [IPV4_{i}]! " for i in range(1, 31))
    assert texts == {"f0.txt": body + "\n", "f1.txt": body + "\nx"}
    assert found.count() == 180


def test_model_spans_go_without_the_texts(spark, monkeypatch):
    """the same steps beside spans over seams; a null text stays null, an empty one empty."""
    df = spark.createDataFrame([(1, "met Clara, N7; of 7, and a@b.co!"), (2, None), (3, "")], "id long, text string")
    ner = spark.createDataFrame([(1, 4, 13, "PERSON"), (1, 12, 19, "LOC")], "id long, start int, end int, label string")
    red = chunked.redact_chunks(chunked.chunks(df, "id", "text", chunk_chars=3), "id", ner=ner, with_vault=True)
    whole = {r.id: r for r in api.redact(df, "id", "text", ner=ner, with_vault=True).collect()}
    rows = red.orderBy("id", "block", "idx").collect()
    assert {i: [r.original_text for r in rows if r.id == i] for i in (2, 3)} == {2: [None], 3: [""]}
    assert {r.id: r.replacements for r in rows if r.id != 1} == {2: None, 3: []}
    assert "".join(r.redacted_text for r in rows if r.id == 1) == whole[1].redacted_text
    assert [tuple(x) for r in rows if r.id == 1 for x in r.replacements] == [tuple(x) for x in whole[1].replacements]


def test_files_of_the_range_query_are_given_back(spark, tmp_path):
    """the scratch files are gone before the result is read."""
    spark.createDataFrame([(8, "é a@b.co"), (0, "x c@d.io"), (1, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    df = queries.file_ranges_offsets(spark, str(tmp_path))
    assert not [x for x in os.listdir(base) if x.startswith("ranges-")]
    assert {tuple(r) for r in df.collect()} == {(0, "[EMAIL_1]", "c@d.io", 2, 2), (0, "[EMAIL_2]", "a@b.co", 11, 14)}


def test_rows_with_own_rules_are_dealt_out(spark, tmp_path):
    """one row group of orders is searched by all cores."""
    rows = spark.range(1, 40).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.lit("1995-01-01").alias("o_orderdate"))
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    df = queries.QUERIES["planted_row_rules"](spark, str(tmp_path))
    assert "RepartitionByExpression" in _plan(df) or _plan(df).count("Repartition ") > 1
    assert df.count() == 39


WORDS = ["Mail", "mail", "no.7", "_a", "7", "é", ".x", "a.", "ß", "k", "a b", "\\E.x", "(", "x\n", "ſ", "K"]


def test_own_keywords_are_found_as_those_of_the_settings(spark):
    """the smaller pattern of a row's keyword has the same edges."""
    texts = ["Mail mail. no.7 no.77 _a a_a 7 77 é eé É .x x.x a. a.b", "ß SS k K kk a  b a b A B \\E.x (k) x\n_x\n ſ s S", "́Mail‍ ٣7 7٣ 7́", MARK + "Mail" + MARK, ""]
    texts = [*texts, (texts[0] + " ") * 40]  # longer than a short one
    assert len(texts[-1]) > SHORT_BYTES
    df = spark.createDataFrame([(i, t, [None, "", w]) for i, t in enumerate(texts) for w in WORDS], "id long, text string, words array<string>").withColumn("n", F.element_at("words", 3))
    only = {k: k == "custom" for k in R.DEFAULT_TOGGLES}
    own = api.candidates(df, ["id", "n"], "text", RedactionConfig(enabled_categories=only), normalize="none", row_keywords="words").select("id", "n", "start", "end", "value")
    got, expected = sorted(map(tuple, own.collect())), []
    for w in WORDS:
        rows = api.candidates(df.where(F.col("n") == w), ["id", "n"], "text", RedactionConfig(enabled_categories=only, custom_keywords=[w]), normalize="none")
        expected += map(tuple, rows.select("id", "n", "start", "end", "value").collect())
    assert got == sorted(expected) and len(got) > 100
    assert all(texts[i][a:b] == v for i, _, a, b, v in got)


def test_switched_off_keywords_are_not_searched(spark):
    """only where the row's own switch says so, the keywords go unsearched."""
    rows = [(1, {"custom": False}), (2, {"custom": True}), (3, {"emails": False}), (4, None), (5, {"custom": None})]
    df = spark.createDataFrame(rows, "id long, own map<string,boolean>").withColumns({"text": F.lit("a@mail.org"), "words": F.array(F.lit("mail"))})
    red = api.redact(df, "id", "text", row_toggles="own", row_keywords="words")
    assert {r.id: r.redacted_text for r in red.collect()} == {1: "[EMAIL_1]", 2: "[EMAIL_1]", 3: "a@[CUSTOM_1].org", 4: "[EMAIL_1]", 5: "[EMAIL_1]"}


@pytest.mark.parametrize("n", [0, 1, 4, 5, redact.FEW_HITS, redact.FEW_HITS + 1, 40])
def test_short_texts_are_marked_at_once(spark, n):
    """places by what stands before a mark, with any number of hits, marks in the text and characters of several bytes."""
    pattern = R.RULES_BY_TYPE["EMAIL"].java
    assert "%+-]++@" in pattern
    for between in (" é漢😀, ", " " + MARK + " ", " " * SHORT_BYTES):
        text = between.join(f"u{i}@b.co" for i in range(n)) + between
        got = spark.range(1).select(F.lit(text).alias("t")).select(F.expr(find_all_sql("t", pattern, ("@",))).alias("f")).first().f
        assert [r.value for r in got] == [f"u{i}@b.co" for i in range(n)]
        assert all(text[r.start : r.end] == r.value for r in got)


def test_numbers_of_few_and_many_hits_agree(spark, monkeypatch):
    """tokens and places of up to FEW_HITS hits, also behind numbers given out before."""
    types = ["EMAIL", "my type", "EMAIL", "--", "SSN", "EMAIL", "my-type", "SSN"]
    hit = lambda i, t: f"named_struct('start', {10 * i}, 'end', {10 * i + i}, 'entity_type', {lit(t)}, 'value', 'v{i}', 'category', 'pii', 'source', 'pii')"
    sel = f"array({', '.join(hit(i, t) for i, t in enumerate(types))})"
    given = "array(named_struct('p', 'SSN', 'n', 9), named_struct('p', 'MY_TYPE', 'n', 99))"

    def run():
        row = spark.range(1).selectExpr(f"{redact.work_sql(sel)} AS a", f"{redact.work_sql(sel, given)} AS b", f"{redact.work_sql(f'slice({sel}, 1, 0)')} AS c").first()
        return [[tuple(x) for x in row[k]] for k in "abc"]

    few = run()
    monkeypatch.setattr(redact, "FEW_HITS", -1)
    assert few == run() and [x[4] for x in few[1]][4:] == ["[SSN_10]", "[EMAIL_3]", "[MY_TYPE_101]", "[SSN_11]"]
