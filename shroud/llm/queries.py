"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table; DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import (
    ball_tree,
    bin_packing,
    fm_quality,
    host_rules,
    kn_toxicity,
    license_scan,
    line_templates,
    norm_topk,
    pareto_mix,
    simhash_bytes,
    token_fst,
    whitening,
    winnowing,
)
from shroud.llm.common import table

SHINGLE, MAX_BITS = 3, 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "text")


def op3_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fm_quality.train(docs, labels, fold(4) != 2, meta_cols=("n_chars",))
    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return fm_quality.quality(docs, model, meta_cols=("n_chars",)).select("doc_id", held, "score", "predicted")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> kn_toxicity.Model:
    """The logistic from a bounded sample of fold 1, counts from all else of the folds 1 to 4, nothing from fold 0."""
    return kn_toxicity.train(docs, table(spark, sf_dir, "labels"), fold(5) >= 2, fold(5) == 1)


def op6_kn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return kn_toxicity.toxicity(docs, toxicity_model(spark, sf_dir, docs)).select("doc_id", held, "score", "predicted")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bytes.near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, max_bits=MAX_BITS)
    return found.select("doc_id", simhash_bytes.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_token_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fst.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_bit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_line_templates, op3_norm_topk, op4_pareto_mix, op5_fm_quality, op6_kn_toxicity, op7_host_rules, op8_simhash_bytes, op9_bin_packing, op10_token_fst, op11_winnowing, op12_bit_whitening, op13_ball_tree, pipeline)
}

#: Quadratic in the vectors, for small tables.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

#: The templates as texts instead of hashes.
LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), raw AS (
  SELECT doc_id, pos, list_filter(string_split_regex(line, '[ \t-\r]+'), lambda t: t <> '') AS r FROM lines
), masked AS (
  SELECT doc_id, pos, r, list_transform(r, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS m FROM raw WHERE len(r) >= 8
), t AS (
  SELECT doc_id, pos, CASE WHEN 2 * len(list_filter(m, lambda x: x = '<*>')) <= len(r) THEN m ELSE r END AS t FROM masked
), parts AS (
  SELECT doc_id, pos, len(t) AS n, array_to_string(t[1:4], ' ') AS lead,
    list_transform([0, 1, 2, 3], lambda i: array_to_string(t[5 + (len(t) - 4) * i // 4 : 4 + (len(t) - 4) * (i + 1) // 4], ' ')) AS s FROM t
), keys AS (
  SELECT doc_id, pos, unnest([
    concat_ws(chr(10), n, lead, 0, s[2], s[3], s[4]), concat_ws(chr(10), n, lead, 1, s[1], s[3], s[4]),
    concat_ws(chr(10), n, lead, 2, s[1], s[2], s[4]), concat_ws(chr(10), n, lead, 3, s[1], s[2], s[3])]) AS k FROM parts
), recurring AS (
  SELECT k, min(doc_id) AS first FROM keys GROUP BY k HAVING min(doc_id) < max(doc_id)
), dropped AS (
  SELECT DISTINCT keys.doc_id, pos FROM keys JOIN recurring USING (k) WHERE keys.doc_id <> first
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(d.pos) AS BIGINT) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY lines.pos) FILTER (WHERE d.pos IS NULL), '') AS text
FROM lines LEFT JOIN dropped d USING (doc_id, pos) GROUP BY doc_id
"""

#: Windows of eight words as texts instead of hashes; the hosts' prior by the same moments.
HOST_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_no, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d
), windows AS (
  SELECT row_no, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), found AS (
  SELECT row_no, list(i) AS places FROM windows GROUP BY row_no, win HAVING count(*) > 1
), covered AS (
  SELECT row_no, count(DISTINCT place) AS n
  FROM (SELECT row_no, unnest(range(i, i + 8)) AS place FROM (SELECT row_no, unnest(places) AS i FROM found)) GROUP BY row_no
), measured AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (row_no) LEFT JOIN covered USING (row_no)
), failing AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT host, count(*) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS f FROM failing GROUP BY host
), moments AS (
  SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS square, count(*) / sum(n) AS inverse FROM hosts
), noise AS (
  SELECT mean, square - mean * mean - mean * (1 - mean) * inverse AS spread FROM moments
), prior AS (
  SELECT mean, CASE WHEN spread > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM noise
), refused AS (
  SELECT host FROM hosts, prior WHERE (f + mean * strength) / (n + strength) > 0.8
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM refused r WHERE r.host IS NOT DISTINCT FROM failing.host) AS kept
FROM failing
"""

#: Windows of ten words (or a whole shorter item) as texts instead of fingerprints.
WINNOWING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)
), places AS (
  SELECT row_no, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT row_no, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)
), hits AS (
  SELECT row_no, i, m, item FROM places JOIN windows USING (m, win)
), marked AS (
  SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(i, i + m)) AS place FROM hits) GROUP BY row_no
), named AS (
  SELECT row_no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row_no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (row_no) LEFT JOIN named USING (row_no)
"""

#: Every document scored for every item.
RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), tf AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(w) AS term FROM d) GROUP BY row_no, term
), sums AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), asked AS (
  SELECT query, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS query, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY query, item_id, term
), scored AS (
  SELECT query, item_id, row_no, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(w) * n) // l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN d USING (row_no), sums GROUP BY query, item_id, row_no, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

#: Licence labels of the fuzzy search, models, fingerprints, samples and token ids have no SQL form: tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_line_templates": LINE_SQL, "op3_norm_topk": TOP_K_SQL, "op7_host_rules": HOST_SQL, "op11_winnowing": WINNOWING_SQL, "op13_ball_tree": RANKED_SQL}
