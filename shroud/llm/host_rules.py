"""Quality rules with host verdicts (DataFrame functions only).

Each document is measured whole: words, code points in words, symbols, repeated
lines, and the words that stand in windows of eight words found twice or more.
A document that fails a rule is not kept.  Failures are then summed by host
(partial sums before the shuffle, so a host with a third of all rows costs a row
per task), the hosts' rates are shrunk with a beta prior fitted to all hosts by
moments, and a host of any size is refused if the shrunk rate is above
``max_rate``: the prior alone holds back hosts of few documents.  Verdicts join
back on (host, salt), so a large host is spread over tasks.

Repeated windows are found inside a row without a shuffle: the 64-bit hashes of
the windows are sorted with their places, equal neighbours are marked, and one
pass over the marked places counts the words they cover.

Defined results: null texts have no words and fail; repeated rows and null ids
are kept row by row; rows with a null host form one host; an empty table gives
an empty result; only id, host and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import SPACES, columns, cut, let

WINDOW, SALTS = 8, 16


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of ``window`` words found twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            # the places whose hash equals its neighbour's on either side
            after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(after, lambda p: p.isNotNull()))))

        def width(places: Column) -> Column:
            gaps = F.zip_with(F.slice(places, 2, F.size(places)), F.slice(places, 1, F.size(places) - 1), lambda b, a: F.least(b - a, F.lit(window)))
            return F.aggregate(gaps, F.lit(window).cast("long"), lambda acc, g: acc + g)

        return let(let(placed, marked), width)

    def over(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - window + 1), lambda i: F.xxhash64(F.slice(ws, i, window)))
        counted = lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(covered(hs))
        return F.when(F.size(ws) <= window, F.lit(0).cast("long")).otherwise(let(hashes, counted))

    return let(words, over)


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, host`` and the measures of the whole text."""
    rows = columns(docs, doc_id=id_col, host=host_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def dup_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    measured = rows.withColumn("words", words)
    return measured.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), dup_lines).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_verdicts(failures: DataFrame, max_rate: float = 0.8) -> DataFrame:
    """From ``host, failed``: ``host, host_docs, host_failed, host_rate, host_refused``."""
    hosts = cut(failures.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    # moments of the rates, each host weighing as its documents
    n, k, mean, square, inverse = hosts.agg(
        F.sum("host_docs"), F.count("*"), F.sum("host_failed") / F.sum("host_docs"), F.sum(F.col("host_docs") * rate * rate) / F.sum("host_docs"), F.count("*") / F.sum("host_docs")
    ).first()
    mean = mean or 0.0
    spread = (square or 0.0) - mean * mean - mean * (1 - mean) * float(inverse or 0.0)  # what binomial noise does not explain
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6 if k else 1.0
    a, b = mean * strength, (1 - mean) * strength
    shrunk = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_refused", F.col("host_rate") > max_rate)


def rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = 0.8) -> DataFrame:
    """Measures, ``base_failed``, the host's figures and ``kept`` for every row."""
    measured = cut(measures(docs, id_col, host_col, text_col).withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(measured.select("host", F.col("base_failed").alias("failed")), max_rate)
    spread = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "h").withColumnRenamed("salt", "t")
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, salted["host"].eqNullSafe(spread["h"]) & (salted["salt"] == spread["t"]), "left").drop("h", "t", "salt")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))
