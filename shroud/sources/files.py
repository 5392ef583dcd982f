"""Sources and sinks.

* ``read_text_files``  - whole files as UTF-8 texts (S1, S2): ``binaryFile``
  listing, suffix allow-list on the last path component, strict UTF-8
  decoding (bad bytes -> ``error`` column, not a failed job), universal
  newlines.  Spark's file listing skips names starting with ``.`` or ``_``.
* ``read_table``       - any table or parquet path with key and text columns (S3).
* ``read_catalogue``   - a ``[{name, regex}, ...]`` JSON rule catalogue (S4).
* ``load_config`` / ``save_config`` - settings JSON through Spark (S5, S6).
* ``read_rules_file``  - one custom rule per line, trimmed, blanks dropped (S7).
* ``write_redacted`` / ``write_vault`` - sinks (S8, S9): the vault is a
  separate, explicit call; all-blank outputs are not written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.config import RedactionConfig
from shroud.functions import rules as R


def file_suffix(name_col) -> "F.Column":
    """Lower-cased suffix of a file name like ``pathlib``: '' for '.bashrc', 'a.' or 'README'."""
    return F.lower(F.regexp_extract(name_col, r"^.+(\.[^.]+)$", 1))


def read_text_files(
    spark: SparkSession,
    path: str,
    extensions: Sequence[str] | None = R.TEXT_SUFFIXES,
    recursive: bool = True,
    max_bytes: int = 2_000_000_000,
) -> DataFrame:
    """``path, name, text, error`` per file; ``extensions=None`` accepts every file.

    A file that is not read has a null text and its reason in ``error``: another
    suffix, more than ``max_bytes`` (what a value holds; ``sources.ranges`` reads files of
    any size, as chunks), or bytes that are not UTF-8.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.withColumn("name", F.element_at(F.split(F.col("path"), "/"), -1))
    known = F.lit(True) if extensions is None else file_suffix(F.col("name")).isin(*[e.lower() for e in extensions])
    small = F.col("length") <= max_bytes  # reaches the reader: larger files are not opened
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    read = files.where(small).where(known).select(
        "path", "name", F.regexp_replace(decoded, "\r\n?", "\n").alias("text"), F.when(decoded.isNull(), F.lit("invalid utf-8")).alias("error")
    )
    reason = F.when(~known, F.lit("unsupported file type")).otherwise(F.lit("file too large"))
    left_out = files.where(~known | ~small).select("path", "name", F.lit(None).cast("string").alias("text"), reason.alias("error"))
    return read.unionByName(left_out)


def read_table(spark: SparkSession, source: str, keys: Sequence[str], text: str, fmt: str = "parquet") -> DataFrame:
    """Keys and text from a table name or a path (S3); only those columns are read."""
    if fmt == "table":
        df = spark.table(source)
    else:
        df = spark.read.format(fmt).load(source)
    return df.select(*keys, text)


def read_catalogue(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered ``(name, regex)`` rules from a JSON array file.

    A catalogue is configuration (a handful of rules), so it is brought to
    the driver to build the plan; the data itself never is.
    """
    rows = (
        spark.read.schema("name string, regex string")
        .option("multiLine", "true")
        .json(path)
        .withColumn("_pos", F.monotonically_increasing_id())
        .orderBy("_pos")
        .collect()
    )
    return [(r["name"], r["regex"]) for r in rows if r["name"] and r["regex"]]


def read_rules_file(spark: SparkSession, path: str) -> list[str]:
    """Custom rules, one per line: trimmed, blank lines dropped, order kept."""
    lines = spark.read.text(path, wholetext=True).collect()
    out: list[str] = []
    for row in lines:
        out += [ln.strip() for ln in row["value"].splitlines() if ln.strip()]
    return out


def load_config(spark: SparkSession, path: str) -> RedactionConfig:
    """Settings from a JSON file or folder; defaults where there is none, or no valid JSON."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # an outage must not switch the custom rules off
        return RedactionConfig()
    text = "".join(r["value"] for r in rows)
    return RedactionConfig.from_json(text)


def save_config(spark: SparkSession, config: RedactionConfig, path: str) -> None:
    """Write the settings as pretty JSON (one text file in ``path``)."""
    spark.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_redacted(redacted: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write redacted rows, skipping all-blank (not null) outputs (S8).  Never writes values."""
    cols = [c for c in redacted.columns if c not in ("original_text", "replacements", "token_to_original")]
    blank = F.regexp_replace("redacted_text", f"[{R.SPACE_SET}]+", "") == ""
    out = redacted.where(~F.coalesce(blank, F.lit(False))).select(*cols)  # null texts are rows of the table and stay
    out.write.format(fmt).mode(mode).save(path)


def write_vault(vault: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write the token -> value table to its own (separately secured) location."""
    w = vault.write.format("parquet").mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
