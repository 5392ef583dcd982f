"""Sources, sinks, settings, vault/restore, NER span join, statistics, streaming."""

import json

from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.operators import evaluate, stats
from shroud.sources import files
from shroud.streaming import stream


def test_text_file_source(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"mail a@b.io\r\nline2\rline3")
    (tmp_path / "b.MD").write_text("x@y.io")
    (tmp_path / "c.bin").write_text("z@z.io")
    (tmp_path / "noext").write_text("n@n.io")
    (tmp_path / "bad.log").write_bytes(b"\xff\xfe bad")
    df = files.read_text_files(spark, str(tmp_path))
    got = {r.name: (r.text, r.error) for r in df.collect()}
    assert set(got) == {"a.txt", "b.MD", "noext", "bad.log", "c.bin"}
    assert got["c.bin"] == (None, "unsupported file type")
    assert got["a.txt"] == ("mail a@b.io\nline2\nline3", None)
    assert got["bad.log"] == (None, "invalid utf-8")
    every = files.read_text_files(spark, str(tmp_path), extensions=None)
    assert every.count() == 5
    red = api.redact(df.where("error IS NULL"), "path", "text")
    assert red.where(F.col("redacted_text").contains("[EMAIL_1]")).count() == 3


def test_settings_and_rules_files(spark, tmp_path):
    cfg = RedactionConfig(enabled_categories={"emails": False}, custom_keywords=["orbital"])
    files.save_config(spark, cfg, str(tmp_path / "settings"))
    back = files.load_config(spark, str(tmp_path / "settings"))
    assert back.toggles["emails"] is False and back.toggles["phones"] is True
    assert back.custom_keywords == ["orbital"]
    assert files.load_config(spark, str(tmp_path / "missing")).toggles["emails"] is True
    (tmp_path / "bad.json").write_text("[1, 2]")
    assert files.load_config(spark, str(tmp_path / "bad.json")).custom_regex == []
    (tmp_path / "rules.txt").write_text("  alpha \n\n beta\n   \n")
    assert files.read_rules_file(spark, str(tmp_path / "rules.txt")) == ["alpha", "beta"]
    (tmp_path / "cat.json").write_text(json.dumps([{"name": "ACME_KEY", "regex": r"\bacme_[0-9]{4}\b"}]))
    cat = files.read_catalogue(spark, str(tmp_path / "cat.json"))
    df = spark.createDataFrame([(1, "k acme_1234 and sk-abcdefghijklmnopqrstuvwxyz")], "id long, text string")
    r = api.redact(df, "id", "text", RedactionConfig(catalogue=cat)).first()
    assert r.redacted_text == "k [ACME_KEY_1] and sk-abcdefghijklmnopqrstuvwxyz"


def test_sink_skips_blank_and_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.io"), (2, "   ")], "id long, text string")
    red = api.redact(df, "id", "text", with_vault=True)
    files.write_redacted(red, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 1
    assert "original_text" not in out.columns and "replacements" not in out.columns


def test_vault_restore_edited(spark):
    df = spark.createDataFrame([(1, "Bob Stone a@b.io"), (2, "nothing here")], "id long, text string")
    red = api.redact(df, "id", "text", with_vault=True)
    v = api.vault(red, "id")
    edited = red.select("id", F.concat(F.lit(">> "), "redacted_text", F.lit(" <<")).alias("redacted_text"))
    got = {r.id: (r.restored_text, r.status) for r in api.restore(edited, v, "id").collect()}
    assert got[1] == (">> Bob Stone a@b.io <<", "restored")
    assert got[2] == (">> nothing here <<", "nothing_to_restore")
    assert "original_value" not in api.redact(df, "id", "text").columns


def test_ner_span_table(spark):
    df = spark.createDataFrame([(1, "Ann lives in Paris. Mail a@b.io")], "id long, text string")
    spans = spark.createDataFrame(
        [(1, 0, 3, "person"), (1, 13, 18, "GPE"), (1, 5, 4, "LOC"), (1, 20, 24, "ORG")],
        "id long, start int, end int, label string",
    )
    r = api.redact(df, "id", "text", ner=spans).first()
    assert r.redacted_text == "[PERSON_1] lives in [LOCATION_1]. Mail [EMAIL_1]"


def test_status_and_stats(spark):
    df = spark.createDataFrame(
        [(1, "a@b.io c@d.io sk-abcdefghijklmnopqrstuvwxyz Bob Stone", "en"), (2, "plain", "fr")],
        "id long, text string, lang string",
    )
    red = api.redact(df, "id", "text")
    st = {r.id: r.status for r in stats.status_line(red, "id").collect()}
    assert st[1] == "1 API keys, 2 emails, 1 names redacted"  # sorted by label, code-point order
    assert st[2] == "No redactions found"
    found = api.scan(df, ["id", "lang"], "text")
    cs = {(r.lang, r.entity_type): r.n for r in stats.corpus_stats(found, df, "id", ["lang"]).collect()}
    assert cs[("en", "EMAIL")] == 2 and cs[(None, "EMAIL")] == 2
    sizes = stats.text_sizes(df, "id", "text").where("id = 2").first()
    assert (sizes.n_chars, sizes.n_words) == (5, 1)


def test_toggle_leaks(spark):
    df = spark.createDataFrame([(1, "a@b.io Bob Stone 10.0.0.1")], "id long, text string")
    toggles = {"emails": False, "ips": False}
    found = api.scan(df, "id", "text", RedactionConfig(enabled_categories=toggles))
    assert evaluate.toggle_leaks(found, toggles).count() == 0
    assert {r.entity_type for r in found.collect()} == {"PERSON"}


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").write.parquet(str(src))
    batch = api.redact(spark.read.parquet(str(src)), "doc_id", "text")
    sdf = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    q = (
        stream.redact_stream(sdf, "doc_id", "text")
        .writeStream.format("memory").queryName("shroud_stream_test")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.table("shroud_stream_test").select("doc_id", "redacted_text")
    want = batch.select("doc_id", "redacted_text")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_stream_foreach_batch_with_vault(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a@b.io"), (2, "Bob Stone")], "id long, text string").write.parquet(str(src))
    sdf = spark.readStream.schema("id long, text string").parquet(str(src))
    q = stream.write_redacted_and_vault(
        stream.redact_stream(sdf, "id", "text", with_vault=True), ["id"],
        str(tmp_path / "out"), str(tmp_path / "ck"), vault_path=str(tmp_path / "vault"),
    )
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert spark.read.parquet(str(tmp_path / "vault")).count() == 2


def test_windowed_counts_stream(spark, tmp_path):
    src = tmp_path / "ev"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "props").write.parquet(str(src))
    sdf = spark.readStream.schema("event_id long, ts timestamp_ntz, props string").parquet(str(src))
    sdf = sdf.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = stream.windowed_type_counts(sdf, ["event_id", "ts"], "props", "ts")
    q = (agg.writeStream.format("memory").queryName("shroud_win_test").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("shroud_win_test").count() == 0  # these props hold no finding
