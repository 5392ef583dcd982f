"""User regexes (D13): Python ``re`` inside one Arrow-batched pandas UDF.

Custom rules are written in Python's dialect and must behave exactly as there
(case-insensitive, invalid ones skipped, empty matches dropped).  Java's
engine differs in details that matter for free-form user patterns (empty
matches split surrogate pairs, different class syntax), so this one detector
stays in Python.  It is a small helper: one ``finditer`` per pattern per text,
vectorised over Arrow batches; all ranking and rewriting stays in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CUSTOM_SPAN_TYPE = "array<struct<start:int,end:int,value:string,rule:int>>"


def custom_regex_spans(text: Column, patterns: list[str]) -> Column:
    """``array<struct<start,end,value,rule>>``: every non-empty match of every pattern.

    ``patterns`` must already be validated (see ``config.valid_python_regexes``);
    ``rule`` is the pattern's position in the list.
    """
    pats = list(patterns)

    @F.pandas_udf(CUSTOM_SPAN_TYPE)
    def _scan(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p, flags=re.IGNORECASE) for p in pats]
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            hits = []
            for k, rx in enumerate(compiled):
                for m in rx.finditer(t):
                    if m.start() < m.end():
                        hits.append({"start": m.start(), "end": m.end(), "value": m.group(0), "rule": k})
            out.append(hits)
        return pd.Series(out)

    return _scan(text)
