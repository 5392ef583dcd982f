"""shroud: PII and secret discovery, redaction and restore on Spark DataFrames."""

__version__ = "0.1.0"
