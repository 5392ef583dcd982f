"""Registered queries: each reads the driver tables of one scale factor.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``
(DuckDB SQL over the same tables, computed independently; see ``oracles``).
Column names are identical on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.functions import rules as R
from shroud.functions.normalize import normalize_column
from shroud.operators import chunked, stats
from shroud.operators.detect import rule_spans
from shroud.plans import oracles as O
from shroud.plans import planted

# Fixed parameters of the registered custom-rule queries.
KEYWORDS = ("token", "license", "example")
CUSTOM_REGEXES = (r"mail\d+\.example\.com", r"version \d+(?:\.\d+)?", r"[unclosed")
TOGGLES_OFF = {"emails": False, "names": False}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


# --------------------------------------------------------------------------- detectors


def _detector_query(entity: str, table: str, key: str, col: str):
    rule = R.RULES_BY_TYPE[entity]

    def run(spark, sf_dir):
        df = _read(spark, sf_dir, table).select(key, F.col(col).alias("__raw"))
        df = normalize_column(df, "__raw", "__t").select(key, "__t")
        out = df.select(key, F.explode_outer(rule_spans("__t", rule)).alias("m"))
        return out.where(F.col("m").isNotNull()).select(key, "m.start", "m.end", "m.value")

    src = O.source_sql(table, key, col)
    sql = f'SELECT k AS {key}, start, "end", value FROM {O.rule_spans_sql(src, "k", entity)}'
    return run, sql


DETECTOR_QUERIES = {
    "email_findings": ("EMAIL", "documents", "doc_id", "text"),
    "phone_findings": ("PHONE", "documents", "doc_id", "text"),
    "ssn_findings": ("SSN", "documents", "doc_id", "text"),
    "nid_findings": ("NID", "pages", "page_id", "html"),
    "dob_findings": ("DOB", "documents", "doc_id", "text"),
    "card_findings": ("CREDIT_CARD", "documents", "doc_id", "text"),
    "person_findings": ("PERSON", "documents", "doc_id", "text"),
    "address_findings": ("ADDRESS", "documents", "doc_id", "text"),
    "ipv4_findings": ("IPV4", "pages", "page_id", "html"),
    "ipv6_findings": ("IPV6", "documents", "doc_id", "text"),
}


def secret_findings(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    cfg = RedactionConfig(enabled_categories={k: k == "api_keys" for k in R.DEFAULT_TOGGLES})
    return api.candidates(docs, "doc_id", "text", cfg).select("doc_id", "start", "end", "entity_type", "value")


def _secret_sql():
    src = O.source_sql("documents", "doc_id", "text")
    parts = [
        f"SELECT k AS doc_id, start, \"end\", {O.q(name)} AS entity_type, value FROM {O.rule_spans_sql(src, 'k', name)}"
        for name, _ in R.SECRET_CATALOGUE
    ]
    return "\nUNION ALL\n".join(parts)


def keyword_findings(spark, sf_dir):
    cfg = RedactionConfig(enabled_categories={k: k == "custom" for k in R.DEFAULT_TOGGLES}, custom_keywords=list(KEYWORDS))
    return api.candidates(_docs(spark, sf_dir), "doc_id", "text", cfg).select("doc_id", "start", "end", "value")


def _keyword_sql():
    src = O.source_sql("documents", "doc_id", "text")
    cands = O.candidates_sql(src, {k: k == "custom" for k in R.DEFAULT_TOGGLES}, KEYWORDS)
    # keep the first hit per (start, end): lowest emission
    return (
        f"SELECT k AS doc_id, start, \"end\", arg_min(value, emission) AS value FROM {cands} "
        f"GROUP BY k, start, \"end\""
    )


def custom_regex_findings(spark, sf_dir):
    cfg = RedactionConfig(enabled_categories={k: k == "custom" for k in R.DEFAULT_TOGGLES}, custom_regex=list(CUSTOM_REGEXES))
    return api.candidates(_docs(spark, sf_dir), "doc_id", "text", cfg).select("doc_id", "start", "end", "value")


def _custom_regex_sql():
    src = O.source_sql("documents", "doc_id", "text")
    cores = [rf"mail{O.D}+\.example\.com", rf"version {O.D}+(?:\.{O.D}+)?"]  # the third pattern is invalid: skipped
    parts = [
        f"SELECT k, start, \"end\", value, {i} AS rule FROM {O.raw_spans_sql(src, 'k', 'CUSTOM', core=c, case_insensitive=True, bounded=False)}"
        for i, c in enumerate(cores)
    ]
    u = "(" + " UNION ALL ".join(parts) + ")"
    return f"SELECT k AS doc_id, start, \"end\", arg_min(value, rule) AS value FROM {u} GROUP BY k, start, \"end\""


# --------------------------------------------------------------------------- pipeline


def candidates_all(spark, sf_dir):
    return api.candidates(_docs(spark, sf_dir), "doc_id", "text").select(
        "doc_id", "start", "end", "entity_type", "value", "category"
    )


def findings_resolved(spark, sf_dir):
    return api.scan(_docs(spark, sf_dir), "doc_id", "text")


def pages_findings(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "html")
    return api.scan(pages, "page_id", "html")


def toggle_variants(spark, sf_dir):
    cfg = RedactionConfig(enabled_categories=dict(TOGGLES_OFF))
    return api.scan(_docs(spark, sf_dir), "doc_id", "text", cfg)


def redacted_text(spark, sf_dir):
    return api.redact(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "redacted_text")


def replacement_offsets(spark, sf_dir):
    red = api.redact(_docs(spark, sf_dir), "doc_id", "text", with_vault=True)
    return api.vault(red, "doc_id").drop("text_id")


def counts_by_type(spark, sf_dir):
    return api.counts(_docs(spark, sf_dir), "doc_id", "text")


def counts_by_category(spark, sf_dir):
    return api.counts(_docs(spark, sf_dir), "doc_id", "text", by="category")


def corpus_stats(spark, sf_dir):
    # lang and the document source ride along as scan keys: no join back to documents
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("doc_source"))
    found = api.scan(docs, ["doc_id", "lang", "doc_source"], "text")
    return stats.corpus_stats(found, docs, "doc_id", ["lang", "doc_source"])


def status_summary(spark, sf_dir):
    red = api.redact(_docs(spark, sf_dir), "doc_id", "text")
    return stats.status_line(red, "doc_id")


def roundtrip_audit(spark, sf_dir):
    red = api.redact(api.evened(_docs(spark, sf_dir)), "doc_id", "text", with_vault=True)
    return api.restore_own(red, "doc_id")


def restore_join(spark, sf_dir):
    # redact once for both sides, and keep what they read; values stay with the executors and are written nowhere
    red = api.redact(api.evened(_docs(spark, sf_dir)), "doc_id", "text", with_vault=True).select("doc_id", "redacted_text", "replacements").persist()
    v = api.vault(red, "doc_id")
    edited = red.select("doc_id", F.concat(F.lit("EDITED: "), F.col("redacted_text")).alias("redacted_text"))
    return api.restore(edited, v, "doc_id").select("doc_id", "restored_text")


def text_sizes(spark, sf_dir):
    return stats.text_sizes(_docs(spark, sf_dir), "doc_id", "text")


def conversation_redact(spark, sf_dir):
    conv = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return api.redact(conv, ["conv_id", "turn"], "text").select("conv_id", "turn", "redacted_text")


def benchmark_redact(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    return api.redact(b, "item_id", "text").select("item_id", "redacted_text")


def events_props_findings(spark, sf_dir):
    ev = _read(spark, sf_dir, "events").select("event_id", "props")
    return api.scan(ev, "event_id", "props")


def normalized_text(spark, sf_dir):
    """P1 + P2 on every document (BOM strip, NFKC)."""
    df = normalize_column(_docs(spark, sf_dir), "text", "normalized_text")
    return df.select("doc_id", "normalized_text")


def input_status(spark, sf_dir):
    return stats.input_status(_read(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid

    from shroud.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _docs_stream(spark, sf_dir):
    """documents as a file stream.  A pattern as path: it may name one file or a folder of files, and a plain path must be a folder."""
    return spark.readStream.schema("doc_id long, text string").parquet(f"{sf_dir}/documents.parque[t]")


def stream_redact(spark, sf_dir):
    """documents as a file stream -> redaction -> exactly-once parquet sink, read back."""
    from shroud.streaming.stream import redact_stream

    base = _scratch(spark, "stream-redact")
    sdf = _docs_stream(spark, sf_dir)
    q = (
        redact_stream(sdf, "doc_id", "text")
        .select("doc_id", "redacted_text")
        .writeStream.format("parquet")
        .option("checkpointLocation", base + "/_checkpoint")
        .trigger(availableNow=True)
        .start(base + "/out")
    )
    q.awaitTermination()
    return spark.read.parquet(base + "/out")


def text_files_redact(spark, sf_dir):
    """Every document written as its own .txt file, read back with binaryFile, redacted."""
    from shroud.sources.files import read_text_files

    base = _scratch(spark, "text-files")
    _docs(spark, sf_dir).write.partitionBy("doc_id").text(base)
    files = read_text_files(spark, base)
    keyed = files.select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("long").alias("doc_id"), "text")
    return api.redact(keyed, "doc_id", "text").select("doc_id", "redacted_text")


def stream_vault(spark, sf_dir):
    """documents as a file stream -> foreachBatch writer of rows and vault; the vault read back."""
    from shroud.streaming.stream import read_committed, redact_stream, write_redacted_and_vault

    base = _scratch(spark, "stream-vault")
    sdf = _docs_stream(spark, sf_dir)
    red = redact_stream(sdf, "doc_id", "text", with_vault=True)
    write_redacted_and_vault(red, ["doc_id"], base + "/out", base + "/checkpoint", vault_path=base + "/vault").awaitTermination()
    return read_committed(spark, base + "/out", base + "/vault").drop("stream_id", "batch_id", "text_id")


#: Characters of a chunk in the queries on chunks: small, so that every document has seams inside.
CHUNK_CHARS = 200


def chunked_redacted(spark, sf_dir):
    """Every document cut into chunk rows, redacted, and put together again."""
    red = chunked.redact_long(_docs(spark, sf_dir), "doc_id", "text", chunk_chars=CHUNK_CHARS)
    return chunked.assembled(red, "doc_id").select("doc_id", "redacted_text")


def chunked_offsets(spark, sf_dir):
    """Tokens and offsets by prefix sums over chunks."""
    red = chunked.redact_long(_docs(spark, sf_dir), "doc_id", "text", with_vault=True, chunk_chars=CHUNK_CHARS)
    places = ("original_start", "original_end", "output_start", "output_end")
    found = chunked.vault(red, "doc_id")
    return found.select(*(F.col(c).cast("int").alias(c) if c in places else c for c in found.columns))


#: Files of the range query: some hundred documents each, one line end behind each document.
RANGE_FILES = 8


def _read_tasks(spark, path: str) -> int:
    """Tasks to read a folder with: as many as the session's ``maxPartitionBytes`` gives, four a core at least."""
    from shroud.sources.ranges import listed

    total = listed(spark, path, None).agg(F.sum("length")).first()[0] or 0
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    most = int(number) << 10 * "bkmgtp".index(unit or "b")
    return max(4 * spark.sparkContext.defaultParallelism, -(-total // most))


def _dropped(spark, path: str) -> None:
    """A scratch folder's files are given back."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def file_ranges_offsets(spark, sf_dir):
    """Documents as a few long files, read in byte ranges far smaller than a file; hits with their place in the file."""
    from shroud.sources.ranges import read_text_chunks

    base = _scratch(spark, "ranges")
    builder = spark.newSession()  # the rows that were dealt to the files leave the disk as soon as these are written
    builder.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    lines = _docs(builder, sf_dir).withColumn("part", F.col("doc_id") % RANGE_FILES)
    lines.repartition(RANGE_FILES, "part").sortWithinPartitions("part", "doc_id").select("text", "part").write.partitionBy("part").text(base)
    session = spark.newSession()  # the size of a range is this reader's own setting
    session.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    # ranges stay as small; a task takes as many as this session's own setting gives it bytes, and every core some
    session.conf.set("spark.sql.files.maxPartitionNum", _read_tasks(spark, base))
    pieces = read_text_chunks(session, base, chunk_chars=CHUNK_CHARS)
    _dropped(spark, base)  # the pieces are in the checkpoint folder
    found = chunked.vault(chunked.redact_chunks(pieces, "path", with_vault=True), "path")
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part")
    return found.select(part, "token", "original_value", F.col("original_start").cast("int").alias("original_start"), F.col("output_start").cast("int").alias("output_start"))


def type_totals(spark, sf_dir):
    found = api.scan(_docs(spark, sf_dir), "doc_id", "text")
    return stats.type_totals(found)


# --------------------------------------------------------------------------- oracle SQL


def _docs_src():
    return O.source_sql("documents", "doc_id", "text")


def _sel_cols(key="doc_id"):
    return f'k AS {key}, start, "end", entity_type, value, category, source'


def _oracles() -> dict[str, str]:
    docs = _docs_src()
    out = {name: _detector_query(*spec)[1] for name, spec in DETECTOR_QUERIES.items()}
    out["secret_findings"] = _secret_sql()
    out["keyword_findings"] = _keyword_sql()
    out["custom_regex_findings"] = _custom_regex_sql()
    out["candidates_all"] = (
        f'SELECT k AS doc_id, start, "end", entity_type, value, category FROM {O.candidates_sql(docs)}'
    )
    out["findings_resolved"] = f"SELECT {_sel_cols()} FROM {O.selected_sql(docs)}"
    pages = O.source_sql("pages", "page_id", "html")
    out["pages_findings"] = f"SELECT {_sel_cols('page_id')} FROM {O.selected_sql(pages)}"
    out["toggle_variants"] = f"SELECT {_sel_cols()} FROM {O.selected_sql(docs, TOGGLES_OFF)}"
    out["redacted_text"] = f"SELECT k AS doc_id, redacted_text FROM {O.redacted_sql(docs)}"
    out["replacement_offsets"] = (
        "SELECT k AS doc_id, token, original_value, entity_type, category, original_start, original_end, "
        f"output_start, output_end FROM {O.replacements_sql(docs)}"
    )
    out["counts_by_type"] = f"SELECT k AS doc_id, prefix AS token_prefix, count(*) AS n FROM {O.replacements_sql(docs)} GROUP BY ALL"
    out["counts_by_category"] = f"SELECT k AS doc_id, category, count(*) AS n FROM {O.replacements_sql(docs)} GROUP BY ALL"
    out["corpus_stats"] = f"""
      SELECT d.lang, d.source AS doc_source, s.entity_type, count(*) AS n, CAST(GROUPING(d.lang, d.source, s.entity_type) AS INTEGER) AS rolled_up
      FROM {O.selected_sql(docs)} s JOIN documents d ON d.doc_id = s.k
      GROUP BY GROUPING SETS ((d.lang, d.source, s.entity_type), (d.lang, s.entity_type), (s.entity_type))"""
    labels = " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in R.STATUS_LABELS.items())
    out["status_summary"] = f"""
      WITH c AS (SELECT k, CASE prefix {labels} ELSE lower(prefix) END AS label, count(*) AS n
                 FROM {O.replacements_sql(docs)} GROUP BY ALL),
      l AS (SELECT k, label, sum(n) AS n FROM c GROUP BY ALL),
      s AS (SELECT k, string_agg(CAST(n AS VARCHAR) || ' ' || label, ', ' ORDER BY label) || ' redacted' AS status FROM l GROUP BY k)
      SELECT d.doc_id, coalesce(s.status, 'No redactions found') AS status FROM documents d LEFT JOIN s ON s.k = d.doc_id"""
    out["roundtrip_audit"] = "SELECT doc_id, text AS restored_text FROM documents"
    out["restore_join"] = "SELECT doc_id, 'EDITED: ' || text AS restored_text FROM documents"
    out["text_sizes"] = """
      SELECT doc_id, length(text) AS n_chars,
             len(list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]+'), lambda w: w <> '')) AS n_words
      FROM documents"""
    conv = O.source_sql("conversations", "struct_pack(conv_id := conv_id, turn := turn)", "text")
    out["conversation_redact"] = f"SELECT k.conv_id AS conv_id, k.turn AS turn, redacted_text FROM {O.redacted_sql(conv)}"
    bench = O.source_sql("benchmark", "item_id", "text")
    out["benchmark_redact"] = f"SELECT k AS item_id, redacted_text FROM {O.redacted_sql(bench)}"
    ev = O.source_sql("events", "event_id", "props")
    out["events_props_findings"] = f"SELECT {_sel_cols('event_id')} FROM {O.selected_sql(ev)}"
    out["type_totals"] = f"SELECT entity_type, count(*) AS n FROM {O.selected_sql(docs)} GROUP BY entity_type"
    # the driver tables contain no BOM and nothing NFKC changes: normalisation is the identity here
    out["normalized_text"] = "SELECT doc_id, text AS normalized_text FROM documents"
    out["input_status"] = (
        "SELECT conv_id, turn, CASE WHEN text IS NULL OR length(regexp_replace(text, "
        "'[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]+', '', 'g')) = 0 THEN 'empty' ELSE 'ok' END AS input_status "
        "FROM conversations"
    )
    out["chunked_redacted"] = out["redacted_text"]
    out["chunked_offsets"] = out["replacement_offsets"]
    long_files = f"(SELECT doc_id % {RANGE_FILES} AS k, string_agg(text || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY 1)"
    out["file_ranges_offsets"] = f"SELECT k AS part, token, original_value, original_start, output_start FROM {O.replacements_sql(long_files)}"
    out["stream_redact"] = out["redacted_text"]
    out["stream_vault"] = out["replacement_offsets"]
    files_src = "(SELECT doc_id AS k, text || chr(10) AS text FROM documents)"
    out["text_files_redact"] = f"SELECT k AS doc_id, redacted_text FROM {O.redacted_sql(files_src)}"
    return out


QUERIES = {name: _detector_query(*spec)[0] for name, spec in DETECTOR_QUERIES.items()}
QUERIES.update(
    {
        "secret_findings": secret_findings,
        "keyword_findings": keyword_findings,
        "custom_regex_findings": custom_regex_findings,
        "candidates_all": candidates_all,
        "findings_resolved": findings_resolved,
        "pages_findings": pages_findings,
        "toggle_variants": toggle_variants,
        "redacted_text": redacted_text,
        "replacement_offsets": replacement_offsets,
        "counts_by_type": counts_by_type,
        "counts_by_category": counts_by_category,
        "corpus_stats": corpus_stats,
        "status_summary": status_summary,
        "roundtrip_audit": roundtrip_audit,
        "restore_join": restore_join,
        "text_sizes": text_sizes,
        "conversation_redact": conversation_redact,
        "benchmark_redact": benchmark_redact,
        "events_props_findings": events_props_findings,
        "type_totals": type_totals,
        "normalized_text": normalized_text,
        "input_status": input_status,
        "chunked_redacted": chunked_redacted,
        "chunked_offsets": chunked_offsets,
        "file_ranges_offsets": file_ranges_offsets,
        "stream_redact": stream_redact,
        "stream_vault": stream_vault,
        "text_files_redact": text_files_redact,
    }
)
ORACLES = _oracles()
QUERIES.update(planted.QUERIES)
ORACLES.update(planted.ORACLES)
