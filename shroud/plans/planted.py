"""Queries whose hits are known by construction.

Texts are derived from ``orders``: a value built from the row's keys between a
prefix and a suffix that end and begin with a combining mark or joiner (no word
character to Python, one to Java's own classes).  The oracle therefore needs no
pattern: it states where the value was put and what should come out.

``VALUES`` and the texts are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.functions import rules as R
from shroud.functions.normalize import normalize_column
from shroud.operators import audit, chunked, evaluate, stats
from shroud.operators.detect import rule_spans
from shroud.operators.redact import restore_sql

K = "o_orderkey"
KEY = f"CAST({K} AS STRING)"
MD5 = f"md5({KEY})"
PREFIX = f"CASE {K} % 3 WHEN 0 THEN 'ที่' WHEN 1 THEN 'का' ELSE 'a‿' END"
SUFFIX = f"CASE {K} % 2 WHEN 0 THEN '่ and' ELSE '‍ or' END"


def _pad(number: str, width: int) -> str:
    return f"lpad(CAST({number} % {10 ** width} AS STRING), {width}, '0')"


_EMAIL = f"'u' || {KEY} || '@mail.example.org'"
_SSN = f"{_pad('o_custkey', 3)} || '-' || {_pad(K, 2)} || '-' || {_pad(f'(o_custkey + {K})', 4)}"
_IPV6 = "'2001:db8:' || " + " || ':' || ".join(f"substr({MD5}, {1 + 4 * i}, 4)" for i in range(6))

#: entity: (text before the value, value, rows in which it is a hit)
VALUES = {
    "EMAIL": ("''", _EMAIL, "TRUE"),
    "PHONE": ("''", f"'030 ' || {_pad('o_custkey', 4)} || ' ' || {_pad(K, 4)}", "TRUE"),
    "SSN": ("''", _SSN, "TRUE"),
    "NID": ("''", f"'AB' || {_pad(K, 8)}", "TRUE"),
    "DOB": ("'Born on: '", "CAST(CAST(o_orderdate AS DATE) AS STRING)", "TRUE"),
    "CREDIT_CARD": ("''", f"'4242 4242 4242 424' || CAST({K} % 10 AS STRING)", f"{K} % 10 = 2"),
    "PERSON": ("''", f"'Clara' || chr(28) || 'N' || substr(translate({MD5}, '0123456789', 'ghijklmnop'), 1, 6)", "TRUE"),
    "ADDRESS": ("''", "CAST(o_custkey % 100000 AS STRING) || ' Harbour Lane'", "TRUE"),
    "IPV4": ("''", f"'10.20.' || CAST({K} % 300 AS STRING) || '.7'", f"{K} % 300 <= 255"),
    "IPV6": ("''", _IPV6, "TRUE"),
    "OPENAI_KEY": ("''", f"'sk-' || {MD5}", "TRUE"),
    "GITHUB_TOKEN": ("''", f"'gho_' || substr({MD5}, 1, 30)", "TRUE"),
    "AWS_ACCESS_KEY": ("''", f"'AKIA' || upper(substr({MD5}, 1, 16))", "TRUE"),
    "GOOGLE_API_KEY": ("''", f"'AIza' || {MD5} || 'Q_9'", "TRUE"),
    "STRIPE_KEY": ("''", f"'sk_live_' || {MD5}", "TRUE"),
    "GENERIC_SECRET": ("''", f"{MD5} || '_' || {MD5}", "TRUE"),
}
#: A text with four hits: value, token it becomes, and what stands between.
MIXED = [("'ที่'", _EMAIL, "EMAIL", 1), ("', '", _SSN, "SSN", 1), ("'; '", _EMAIL, "EMAIL", 2), ("' ('", _IPV6, "IPV6", 1)]
MIXED_TEXT = " || ".join(f"{gap} || {value}" for gap, value, _, _ in MIXED) + " || ')'"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(K, "o_custkey", "o_orderdate")


def _dealt(df: DataFrame) -> DataFrame:
    """A few numbers a row over many tasks: what is searched then costs a hundred times the shuffle, and a file may have few row groups."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _mixed(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).select(K, F.expr(MIXED_TEXT).alias("text"))


def _mixed_redacted(spark, sf_dir) -> DataFrame:
    return api.redact(_mixed(spark, sf_dir), K, "text", with_vault=True)


def _planted_rule(entity: str):
    before, value, hit = VALUES[entity]

    def run(spark, sf_dir):
        df = _orders(spark, sf_dir).select(K, F.expr(f"{PREFIX} || {before} || {value} || {SUFFIX}").alias("raw"))
        df = normalize_column(df, "raw", "t")
        found = df.select(K, F.explode_outer(rule_spans("t", R.RULES_BY_TYPE[entity])).alias("m"))
        return found.where("m IS NOT NULL").select(K, "m.start", "m.end", "m.value")

    lead = f"length({PREFIX} || {before})"
    sql = (
        f'SELECT {K}, CAST({lead} AS INTEGER) AS start, CAST({lead} + length({value}) AS INTEGER) AS "end", '
        f"{value} AS value FROM orders WHERE {hit}"
    )
    return run, sql


def planted_redacted(spark, sf_dir):
    return _mixed_redacted(spark, sf_dir).select(K, "redacted_text")


def planted_token_map(spark, sf_dir):
    red = _mixed_redacted(spark, sf_dir)
    return red.select(K, F.explode_outer("token_to_original").alias("token", "original_value")).where("token IS NOT NULL")


def planted_roundtrip(spark, sf_dir):
    """Every text changed, and came back."""
    red = _mixed_redacted(spark, sf_dir)
    back = F.expr(restore_sql("redacted_text", "replacements"))
    return red.select(K, (F.col("redacted_text") != F.col("original_text")).alias("changed"), (back == F.col("original_text")).alias("restored"))


def planted_roundtrip_failures(spark, sf_dir):
    """A vault whose values were lost for odd keys: exactly those rows are reported."""
    red = _mixed_redacted(spark, sf_dir)
    lost = red.withColumn("replacements", F.expr(f"IF({K} % 2 = 1, slice(replacements, 1, 1), replacements)"))
    return evaluate.roundtrip_failures(lost, K).select(K, "original_text")


def planted_recall(spark, sf_dir):
    expected = _orders(spark, sf_dir).select(K, F.expr(f"IF({K} % 2 = 0, array('EMAIL', 'NID|SSN'), array('IPV6', 'DOB'))").alias("expected_any"))
    return evaluate.recall_report(expected, api.redact(_mixed(spark, sf_dir), K, "text"), K)


def planted_toggle_leaks(spark, sf_dir):
    """Findings of an unrestricted run held against settings without e-mails and addresses."""
    leaks = evaluate.toggle_leaks(api.scan(_mixed(spark, sf_dir), K, "text"), {"emails": False, "ips": False})
    return leaks.select(K, "entity_type", "value")


def planted_breakdown(spark, sf_dir):
    return stats.breakdown(api.redact(_mixed(spark, sf_dir), K, "text"))


def planted_normalized(spark, sf_dir):
    wide = f"'﻿﻿' || translate({KEY}, '0123456789', '０１２３４５６７８９') || 'ﬁn'"
    df = _orders(spark, sf_dir).select(K, F.expr(wide).alias("raw"))
    return normalize_column(df, "raw", "normalized_text").select(K, "normalized_text")


def planted_input_status(spark, sf_dir):
    text = f"CASE {K} % 4 WHEN 0 THEN ' ' || chr(28) WHEN 1 THEN '　' WHEN 2 THEN NULL ELSE ' x ' END"
    return stats.input_status(_orders(spark, sf_dir).select(K, F.expr(text).alias("text")), K, "text")


def planted_ner(spark, sf_dir):
    """Names and places from a span table; odd labels, bad offsets and spans past the text fall away, repeats count once."""
    base = _orders(spark, sf_dir)
    texts = base.select(K, F.expr(f"'ที่ met ' || {KEY}").alias("text"))
    label = f"CASE {K} % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'GPE' WHEN 2 THEN 'Loc' ELSE 'ORG' END"
    spans = base.select(
        K,
        F.explode(F.expr(
            f"array(named_struct('s', '0', 'e', '3', 'l', {label}), named_struct('s', '0', 'e', '3', 'l', {label}), "
            f"named_struct('s', '4', 'e', 'x', 'l', 'PERSON'), named_struct('s', '4', 'e', '99', 'l', 'PERSON'))"
        )).alias("x"),
    ).select(K, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.l").alias("label"))
    return api.candidates(texts, K, "text", RedactionConfig(enabled_categories=_only("names", "addresses")), ner=spans).select(
        K, "start", "end", "entity_type", "value", "category"
    )


NAME = f"'Clara, N' || {KEY} || '; of ' || {KEY}"


def planted_ner_chunks(spark, sf_dir):
    """Spans of a model over the seams of chunks of a few characters, and inside them; one names the other's part."""
    base = _orders(spark, sf_dir)
    texts = base.select(K, F.expr(f"'met ' || {NAME} || ', and a@b.co!'").alias("text"))
    spans = base.select(K, F.explode(F.expr(
        f"array(named_struct('s', 4, 'e', 4 + length({NAME}), 'l', 'PERSON'), named_struct('s', 4, 'e', 9, 'l', 'GPE'), named_struct('s', 0, 'e', 3, 'l', 'LOC'))"
    )).alias("x")).select(K, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.l").alias("label"))
    red = chunked.redact_long(texts, K, "text", ner=spans, with_vault=True, chunk_chars=3)
    return chunked.vault(red, K).select(K, "token", "original_value", F.col("output_start").cast("int").alias("output_start"))


def planted_literals(spark, sf_dir):
    """Texts that quote tokens: the audit lists them, and tells which break the round trip."""
    text = f"{_EMAIL} || CASE {K} % 3 WHEN 0 THEN ' quotes [EMAIL_1]' WHEN 1 THEN ' quotes [EMAIL_2]' ELSE ' quotes [EMAIL]' END"
    found = audit.literal_tokens(_orders(spark, sf_dir).select(K, F.expr(text).alias("text")), K, "text")
    return found.select(K, "start", "end", "literal", "assigned", "fails")


def planted_literal_failures(spark, sf_dir):
    """Held against the round trip: the rows that fail it, and the rows with a failing literal."""
    text = f"{_EMAIL} || CASE {K} % 3 WHEN 0 THEN ' quotes [EMAIL_1]' WHEN 1 THEN ' quotes [EMAIL_2]' ELSE ' quotes [EMAIL]' END"
    df = _orders(spark, sf_dir).select(K, F.expr(text).alias("text"))
    failing = evaluate.roundtrip_failures(api.redact(df, K, "text", with_vault=True), K).select(K, F.lit(True).alias("fails"))
    told = audit.literal_tokens(df, K, "text").where("fails").select(K, F.lit(True).alias("told")).distinct()
    return failing.join(told, K, "full").select(K, "fails", "told")


def planted_repeated_keys(spark, sf_dir):
    """Two rows a key: equal redacted texts with different values stay as they are, others get their own values."""
    base = _orders(spark, sf_dir)
    first = F.expr(f"{_EMAIL}")
    second = F.expr(f"CASE {K} % 2 WHEN 0 THEN 'v' || {KEY} || '@mail.example.org' ELSE {_SSN} END")
    rows = base.select(K, first.alias("text")).unionByName(base.select(K, second.alias("text")))
    red = api.redact(rows, K, "text", with_vault=True).select(K, "redacted_text", "replacements").persist()  # redacted once for both sides
    return api.restore(red.select(K, "redacted_text"), api.vault(red, K), K)


def planted_custom_dedupe(spark, sf_dir):
    """One place found by a regex and by two keywords is one candidate."""
    cfg = RedactionConfig(enabled_categories=_only("custom"), custom_regex=["alpha"], custom_keywords=["ALPHA", "alpha"])
    df = _orders(spark, sf_dir).select(K, F.expr(f"{PREFIX} || 'Alpha' || {SUFFIX}").alias("text"))
    return api.candidates(df, K, "text", cfg).select(K, "start", "end", "entity_type", "value")


def planted_catalogue(spark, sf_dir):
    """A catalogue of the user's own in place of the built-in one."""
    cfg = RedactionConfig(enabled_categories=_only("api_keys"), catalogue=[("ORDER_KEY", r"\bord-\d+\b")])
    df = _orders(spark, sf_dir).select(K, F.expr(f"{PREFIX} || 'ord-' || {KEY} || {SUFFIX}").alias("text"))
    return api.scan(df, K, "text", cfg).select(K, "start", "end", "entity_type", "value")


def planted_window_counts(spark, sf_dir):
    from shroud.streaming.stream import windowed_type_counts

    df = _orders(spark, sf_dir).select(K, F.expr("CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)").alias("at"), F.expr(MIXED_TEXT).alias("text"))
    counts = windowed_type_counts(df, [K, "at"], "text", "at", window="1 day")
    return counts.select(F.expr("CAST(CAST(window.start AS DATE) AS STRING)").alias("day"), "entity_type", "n")


def planted_stream_counts(spark, sf_dir):
    """Counts by day as a stream with state: files arrive one by one, the stream stops and goes on from its
    checkpoint, rows behind the watermark are dropped, and a last file closes the days."""
    from shroud.session import ensure_checkpoint_dir
    from shroud.streaming.stream import windowed_type_counts

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-counts-{uuid.uuid4().hex}"
    rows = _orders(spark, sf_dir).select(K, F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, CASE WHEN {K} % 8 = 3 THEN 0 ELSE {K} % 4 END, {K} % 24)").alias("at"), F.expr(MIXED_TEXT).alias("text"), F.expr(f"{K} % 4").alias("file"))
    closing = rows.agg(F.lit(-1).cast("long").alias(K), F.expr("timestamp'2024-02-01 00:00:00'").alias("at"), F.lit("a@b.co").alias("text"))

    def arrive(*files: int) -> None:
        for i in files:
            part = rows.where(F.col("file") == i).drop("file") if i < 4 else closing
            part.repartition(1).write.mode("append").parquet(base + "/in")

    def go_on() -> None:
        stream = spark.readStream.schema(f"{K} long, at timestamp, text string").option("maxFilesPerTrigger", 1).parquet(base + "/in")
        # a file is read by a task or two, its rows are searched by all
        counts = windowed_type_counts(api.evened(stream), [K, "at"], "text", "at", window="1 day", watermark="1 hour")
        counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start(base + "/out").awaitTermination()

    arrive(0, 1)
    go_on()
    arrive(2, 3, 4)
    go_on()
    found = spark.read.schema("window struct<start:timestamp,end:timestamp>, entity_type string, n long").parquet(base + "/out")
    return found.select(F.expr("CAST(CAST(window.start AS DATE) AS STRING)").alias("day"), "entity_type", "n")


def planted_toggle_runs(spark, sf_dir):
    """What a run without e-mails and addresses of hosts loses against one with all."""
    return evaluate.toggled_off(_mixed(spark, sf_dir), K, "text", {"emails": False, "ips": False}).select(K, "entity_type", "value")


#: Rules and keywords of the long lists.
LONG = 2000


def planted_many_rules(spark, sf_dir):
    """A catalogue of 2,000 rules, a broken one among them, and as many keywords."""
    catalogue = [("broken", "[open")] + [(f"rule_{i}", rf"\bk{i}-\d+\b") for i in range(LONG)]
    cfg = RedactionConfig(enabled_categories=_only("api_keys", "custom"), catalogue=catalogue, custom_keywords=[f"word{i}x" for i in range(LONG)])
    text = f"{PREFIX} || 'k' || CAST({K} % {LONG} AS STRING) || '-' || {KEY} || ' and WORD' || CAST({K} % 3000 AS STRING) || 'X'"
    return api.scan(_orders(spark, sf_dir).select(K, F.expr(text).alias("text")), K, "text", cfg).select(K, "start", "entity_type", "value")


def planted_row_rules(spark, sf_dir):
    """Switches and keywords that differ from row to row."""
    toggles = f"IF({K} % 3 = 0, map('emails', false), IF({K} % 3 = 1, map('ips', false, 'custom', false), NULL))"
    words = f"IF({K} % 2 = 0, array('Mail', NULL, '', 'no.' || {KEY}), NULL)"
    df = _dealt(_orders(spark, sf_dir)).select(K, F.expr(f"{MIXED_TEXT} || ' no.' || {KEY}").alias("text"), F.expr(toggles).alias("own"), F.expr(words).alias("words"))
    red = api.redact(df, K, "text", row_toggles="own", row_keywords="words")
    return red.select(K, "redacted_text")


def _only(*on: str) -> dict[str, bool]:
    return {k: k in on for k in R.DEFAULT_TOGGLES}


def _address_with(word: str) -> str:
    return f"'u' || {KEY} || '@' || CASE WHEN {K} % 2 = 0 THEN '{word}' ELSE 'mail' END || '.example.org'"


OFF, OFF2 = _address_with("[CUSTOM_1]"), _address_with("[CUSTOM_2]")


def _oracles() -> dict[str, str]:
    redacted = " || ".join(f"{gap} || '[{name}_{n}]'" for gap, _, name, n in MIXED) + " || ')'"
    rows = "\nUNION ALL\n".join(
        f"SELECT {K}, o_orderdate, '[{name}_{n}]' AS token, '{name}' AS entity_type, {value} AS value FROM orders" for _, value, name, n in MIXED
    )
    lead = f"CAST(length({PREFIX}) AS INTEGER)"
    # with e-mails switched off the row's keyword finds the word inside the address
    own = f"""CASE {K} % 3 WHEN 0 THEN 'ที่' || {OFF} || ', [SSN_1]; ' || {OFF2} || ' ([IPV6_1])'
        WHEN 1 THEN 'ที่[EMAIL_1], [SSN_1]; [EMAIL_2] (' || {_IPV6} || ')' ELSE 'ที่[EMAIL_1], [SSN_1]; [EMAIL_2] ([IPV6_1])' END
        || CASE WHEN {K} % 2 = 1 OR {K} % 3 = 1 THEN ' no.' || {KEY} WHEN {K} % 3 = 0 THEN ' [CUSTOM_3]' ELSE ' [CUSTOM_1]' END"""
    return {
        "planted_row_rules": f"SELECT {K}, {own} AS redacted_text FROM orders",
        "planted_redacted": f"SELECT {K}, {redacted} AS redacted_text FROM orders",
        "planted_token_map": f"SELECT {K}, token, value AS original_value FROM ({rows})",
        "planted_roundtrip": f"SELECT {K}, TRUE AS changed, TRUE AS restored FROM orders",
        "planted_roundtrip_failures": f"SELECT {K}, {MIXED_TEXT} AS original_text FROM orders WHERE {K} % 2 = 1",
        "planted_recall": f"""
          SELECT item, count(*) AS expected, CAST(sum(found) AS BIGINT) AS found, sum(found) / CAST(count(*) AS DOUBLE) AS recall FROM (
            SELECT unnest(CASE WHEN {K} % 2 = 0 THEN ['EMAIL', 'NID|SSN'] ELSE ['IPV6', 'DOB'] END) AS item,
                   unnest(CASE WHEN {K} % 2 = 0 THEN [1, 1] ELSE [1, 0] END) AS found FROM orders) GROUP BY item""",
        "planted_toggle_leaks": f"SELECT {K}, entity_type, value FROM ({rows}) WHERE entity_type IN ('EMAIL', 'IPV6')",
        "planted_breakdown": """
          SELECT * FROM (SELECT 0 AS position, CAST(NULL AS VARCHAR) AS token_prefix, 'Total' AS label, 4 * count(*) AS n FROM orders
          UNION ALL SELECT 1, 'EMAIL', 'Emails', 2 * count(*) FROM orders
          UNION ALL SELECT 2, 'IPV6', 'Ip addresses', count(*) FROM orders
          UNION ALL SELECT 3, 'SSN', 'National ids', count(*) FROM orders) WHERE n > 0""",
        "planted_normalized": f"SELECT {K}, {KEY} || 'fin' AS normalized_text FROM orders",
        "planted_input_status": f"SELECT {K}, CASE WHEN {K} % 4 = 3 THEN 'ok' ELSE 'empty' END AS input_status FROM orders",
        "planted_ner": f"""
          SELECT {K}, 0 AS start, 3 AS "end", CASE {K} % 4 WHEN 0 THEN 'PERSON' ELSE 'LOCATION' END AS entity_type, 'ที่' AS value,
                 CASE {K} % 4 WHEN 0 THEN 'pii' ELSE 'location' END AS category FROM orders WHERE {K} % 4 < 3""",
        "planted_ner_chunks": f"""
          SELECT {K}, '[LOCATION_1]' AS token, 'met' AS original_value, 0 AS output_start FROM orders
          UNION ALL SELECT {K}, '[PERSON_1]', {NAME}, 13 FROM orders UNION ALL SELECT {K}, '[EMAIL_1]', 'a@b.co', 29 FROM orders""",
        "planted_literals": f"""
          SELECT {K}, CAST(length({_EMAIL}) + 8 AS INTEGER) AS start, CAST(length({_EMAIL}) + 17 AS INTEGER) AS "end", '[EMAIL_' || CAST({K} % 3 + 1 AS STRING) || ']' AS literal,
                 {K} % 3 = 0 AS assigned, {K} % 3 = 0 AS fails FROM orders WHERE {K} % 3 < 2""",
        "planted_literal_failures": f"SELECT {K}, TRUE AS fails, TRUE AS told FROM orders WHERE {K} % 3 = 0",
        "planted_repeated_keys": f"""
          SELECT {K}, CASE {K} % 2 WHEN 0 THEN '[EMAIL_1]' ELSE {_EMAIL} END AS restored_text, CASE {K} % 2 WHEN 0 THEN 'ambiguous_key' ELSE 'restored' END AS status FROM orders
          UNION ALL SELECT {K}, CASE {K} % 2 WHEN 0 THEN '[EMAIL_1]' ELSE {_SSN} END, CASE {K} % 2 WHEN 0 THEN 'ambiguous_key' ELSE 'restored' END FROM orders""",
        "planted_stream_counts": f"""
          SELECT CAST(DATE '2024-01-01' + CAST({K} % 4 AS INTEGER) AS VARCHAR) AS day, entity_type, count(*) AS n FROM ({rows}) WHERE {K} % 8 <> 3 GROUP BY ALL""",
        "planted_toggle_runs": f"SELECT {K}, entity_type, value FROM ({rows}) WHERE entity_type IN ('EMAIL', 'IPV6')",
        "planted_many_rules": f"""
          SELECT {K}, {lead} AS start, 'RULE_' || CAST({K} % {LONG} AS STRING) AS entity_type, 'k' || CAST({K} % {LONG} AS STRING) || '-' || {KEY} AS value FROM orders
          UNION ALL SELECT {K}, CAST({lead} + length('k' || CAST({K} % {LONG} AS STRING) || '-' || {KEY}) + 5 AS INTEGER), 'CUSTOM', 'WORD' || CAST({K} % 3000 AS STRING) || 'X' FROM orders WHERE {K} % 3000 < {LONG}""",
        "planted_custom_dedupe": f"SELECT {K}, {lead} AS start, {lead} + 5 AS \"end\", 'CUSTOM' AS entity_type, 'Alpha' AS value FROM orders",
        "planted_catalogue": f"SELECT {K}, {lead} AS start, CAST({lead} + 4 + length({KEY}) AS INTEGER) AS \"end\", 'ORDER_KEY' AS entity_type, 'ord-' || {KEY} AS value FROM orders",
        "planted_window_counts": f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, entity_type, count(*) AS n FROM ({rows}) GROUP BY ALL",
    }


ORACLES = _oracles()
QUERIES = {name: globals()[name] for name in ORACLES}
for _entity in VALUES:
    QUERIES[f"planted_{_entity.lower()}"], ORACLES[f"planted_{_entity.lower()}"] = _planted_rule(_entity)
