"""The reviewer's findings of round 3."""

from pyspark.sql import functions as F

from shroud.operators import chunked
from shroud.plans import queries

ROWS = [(1, "mail a@b.co and c@d.io"), (2, None), (3, "nothing"), (3, "call 030 5559 1274"), (4, "")]


def _documents(spark, path, parts):
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(parts).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_streams_read_documents_that_are_a_folder_of_files(spark, tmp_path):
    d = _documents(spark, tmp_path, 3)
    got = {(r.doc_id, r.redacted_text) for r in queries.stream_redact(spark, d).collect()}
    assert got == {(1, "mail [EMAIL_1] and [EMAIL_2]"), (2, None), (3, "nothing"), (3, "call [PHONE_1]"), (4, "")}
    assert {(r.doc_id, r.token, r.original_value) for r in queries.stream_vault(spark, d).collect()} == {(1, "[EMAIL_1]", "a@b.co"), (1, "[EMAIL_2]", "c@d.io"), (3, "[PHONE_1]", "030 5559 1274")}


def test_streams_read_documents_that_are_one_file(spark, tmp_path):
    d = _documents(spark, tmp_path / "folder", 1)
    (part,) = (tmp_path / "folder" / "documents.parquet").glob("*.parquet")
    (tmp_path / "documents.parquet").write_bytes(part.read_bytes())
    assert d and queries.stream_redact(spark, str(tmp_path)).count() == len(ROWS)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _orders(spark, path):
    rows = spark.range(1, 40).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.lit("1995-01-01").alias("o_orderdate"))
    rows.write.parquet(str(path / "orders.parquet"))
    return str(path)


def test_counts_do_without_the_rewriting(spark, tmp_path):
    d = _orders(spark, tmp_path)
    for name in ("planted_breakdown", "planted_recall"):
        assert "output_start" not in _plan(queries.QUERIES[name](spark, d)), name
    assert "output_start" in _plan(queries.QUERIES["planted_roundtrip"](spark, d))


def test_repeated_keys_are_redacted_once(spark, tmp_path):
    d = _orders(spark, tmp_path)
    df = queries.QUERIES["planted_repeated_keys"](spark, d)
    assert "InMemoryRelation" in _plan(df)
    assert {r.status for r in df.collect()} == {"ambiguous_key", "restored"}


def test_rows_of_large_files_are_evened_out(spark, tmp_path):
    d = _documents(spark, tmp_path, 1)
    assert "RebalancePartitions" in _plan(queries.roundtrip_audit(spark, d))
    assert {(r.doc_id, r.restored_text) for r in queries.roundtrip_audit(spark, d).collect()} == set(ROWS)


def test_ranges_are_packed_into_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n" * 1_000_000)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    assert queries._read_tasks(session, str(tmp_path)) == max(4 * spark.sparkContext.defaultParallelism, -(-2_000_000 // 10240))
    session.conf.set("spark.sql.files.maxPartitionBytes", "134217728b")
    assert queries._read_tasks(session, str(tmp_path)) == 4 * spark.sparkContext.defaultParallelism


def test_any_number_of_hits_keeps_its_places(redact_one):
    texts = [" é, ".join(f"u{i}@b.co" for i in range(n)) for n in (0, 1, 4, 5, 16, 17, 32, 33, 40)]
    got = redact_one(texts)
    for i, text in enumerate(texts):
        reps = got[i].replacements
        assert [r.token for r in reps] == [f"[EMAIL_{k + 1}]" for k in range(len(reps))]
        assert all(text[r.original_start : r.original_end] == r.original_value for r in reps)
        assert all(got[i].redacted_text[r.output_start : r.output_end] == r.token for r in reps)
        assert len(reps) == text.count("@") and dict(got[i].counts_by_type) == ({"EMAIL": len(reps)} if reps else {})


CHUNKED = [(1, "met Clara, N7; of 7, and a@b.co!"), (1, "x, é; y@z.org, Ａnna"), (None, "met, a@b.co"), (2, None), (3, ""), (4, "\ufeff\ufeff, ﬁn! c@d.io; c@d.io"), (5, ", ".join(f"u{i}@b.co" for i in range(70)))]
SPANS = [(1, 4, 19, "PERSON"), (1, 4, 9, "gpe"), (1, 0, 3, "LOC"), (1, 0, 3, "LOC"), (1, 17, 30, "GPE"), (1, 2, 99, "LOC"), (None, 0, 3, "LOC"), (2, 0, 1, "LOC"), (3, 0, 1, "LOC"), (4, 1, 6, "PERSON"), (5, 3, 600, "LOC"), (5, 650, 654, "PERSON")]


def test_chunks_of_a_short_text_stay_in_one_row(spark, monkeypatch):
    """few steps write their rows, and the chunks are those that chunk rows and sums over them give."""
    df = spark.createDataFrame(CHUNKED, "id long, text string")
    ner = spark.createDataFrame(SPANS, "id long, start int, end int, label string")
    written, settled = [], chunked.settled
    monkeypatch.setattr(chunked, "settled", lambda d: written.append(1) or settled(d))

    def run(rows):
        out = chunked.redact_long(rows, "id", "text", ner=ner, with_vault=True, chunk_chars=3)
        got = out.select("id", "block", "idx", "original_text", "redacted_text", "highlights", "replacements").collect()
        return sorted(map(repr, got))

    short = df.where("id < 5 OR id IS NULL")
    together = run(short)
    assert len(written) == 2 and len(together) == 15
    whole = run(df)
    assert len(whole) == len(together) + 70  # the long one is more than one block
    monkeypatch.setattr(chunked, "TOGETHER_CHARS", -1)
    assert whole == run(df)
