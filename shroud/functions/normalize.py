"""Input normalisation: leading byte-order marks, Unicode NFKC.

Spark has no NFKC function, so it runs as an Arrow UDF with Python's own
``unicodedata`` (Arrow's ``utf8_normalize`` leaves letters and accents uncomposed);
pure-ASCII text is already NFKC-normal and is sent as null.  The UDF is
deterministic: filters on other columns pass it and reach the scan, which they do not with a
reflective call into the JVM.
"""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip_bom(text: Column) -> Column:
    """Remove every leading U+FEFF (not only the first); bytes that are not UTF-8 become U+FFFD."""
    return F.regexp_replace(text, "^\ufeff+", "")


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """NFKC of ``text``; only texts beyond ASCII travel."""
    return F.coalesce(_nfkc(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def normalize_column(df, text_col: str, out_col: str, mode: str = "nfkc"):
    """Add ``out_col`` = normalised ``text_col``.

    ``mode``: ``"nfkc"`` (BOM strip then NFKC, the default), ``"bom"`` (BOM
    strip only, for inputs known to be NFKC-normal) or ``"none"``.
    """
    if mode == "none":
        return df.withColumn(out_col, F.col(text_col))
    tmp = "__shroud_nobom"
    df = df.withColumn(tmp, strip_bom(F.col(text_col)))
    if mode == "bom":
        return df.withColumnRenamed(tmp, out_col) if out_col != text_col else df.drop(text_col).withColumnRenamed(tmp, out_col)
    df = df.withColumn(out_col, nfkc(F.col(tmp)))
    return df.drop(tmp)
