"""Fuzzy search for short licence notices.

Texts are read as their words (A-Z lower-cased) with one space between.  A
notice that may hold k edits is split into k + 1 seeds: by the pigeonhole
principle at least one of them stands unchanged in every match.  One automaton
finds all seeds of all notices; each hit opens a window that a match around it
cannot leave, overlapping windows join, and in them the ``regex`` library's
bounded-error matching verifies the edits and gives the span.  A match counts if
the words that tell the notice's licence from its neighbours (``core``) are
unchanged and it starts and ends at word limits.  Exact phrases are notices with
no edits: their one seed is the phrase itself.

Defined results: null and empty texts have no words and no match; a phrase at
several places is reported at each; repeated rows and null ids are kept row by
row; an empty table gives an empty result; other columns are not read.  Whole
texts are searched, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import batches, columns, texts

#: A-Z to lower case, every other ASCII character but a-z and 0-9 to a space; bytes above 0x7F stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Notice(NamedTuple):
    label: str
    phrase: str
    edits: int
    core: str = ""


#: The exact phrases of the contract and their labels.
PHRASES = (
    Notice("mit", "under the mit license", 0),
    Notice("apache-2", "apache license version 2", 0),
    Notice("cc-by-nc", "cc by nc", 0),
)
#: Notices that the fuzzy search adds, with the edits each may hold and the words that may hold none.
NOTICES = (
    Notice("mit", "released under the mit license", 3, "mit"),
    Notice("apache-2", "licensed under the apache license version 2", 3, "apache 2"),
    Notice("gpl-2", "licensed under the gnu general public license version 2", 4, "general 2"),
    Notice("gpl-3", "licensed under the gnu general public license version 3", 4, "general 3"),
    Notice("lgpl", "gnu lesser general public license", 3, "lesser"),
    Notice("agpl", "gnu affero general public license", 3, "affero"),
    Notice("mpl-2", "mozilla public license version 2", 3, "mozilla 2"),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by-nc", "licensed under cc by nc", 2, "cc by nc"),
    Notice("cc-by-sa", "licensed under cc by sa", 2, "cc by sa"),
    Notice("cc0", "licensed under cc0", 2, "cc0"),
    Notice("all-rights-reserved", "all rights reserved", 2, "all"),
    Notice("proprietary", "confidential and proprietary information", 3, "proprietary"),
)
MATCH = "array<struct<label:string,phrase:string,exact:boolean,edits:int,start_word:bigint,end_word:bigint,start_char:bigint,end_char:bigint>>"


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, seed): ``edits + 1`` parts of about equal length."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(s, phrase[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            if notice.edits >= len(notice.phrase):
                raise ValueError(f"{notice.phrase!r} is too short for {notice.edits} edits")
            for offset, seed in seeds(notice.phrase, notice.edits):
                where.setdefault(seed, []).append((i, offset))
        for seed, at in where.items():
            self.automaton.add_word(seed, (len(seed), at))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?e)(?<= )(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?= )") if n.edits else None for n in notices]

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, start, end) of every stretch of text that can hold a match."""
        open_: dict[int, list[list[int]]] = {}
        for last, (length, at) in self.automaton.iter(text):
            for i, offset in at:
                n = self.notices[i]
                start = last + 1 - length - offset - n.edits
                end = start + len(n.phrase) + 2 * n.edits
                found = open_.setdefault(i, [])
                if found and n.edits and start <= found[-1][1] and start >= found[-1][0] - 2 * len(n.phrase):
                    found[-1] = [min(start, found[-1][0]), max(end, found[-1][1])]
                else:
                    found.append([start, end])
        for i, found in open_.items():
            for start, end in found:
                yield i, max(start, 0), min(end, len(text))

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a text of words with a space on either side."""
        out = set()
        for i, start, end in self.windows(text):
            n = self.notices[i]
            if not n.edits:
                if text[start - 1 : start] == " " and text[end : end + 1] == " ":
                    out.add((i, start, end, 0))
                continue
            for m in self.patterns[i].finditer(text, start, end + 1, overlapped=True):
                words = iter(m.group().split(" "))
                if all(w in words for w in n.core.split()):
                    out.add((i, *m.span(), sum(m.fuzzy_counts)))
        return self.best(sorted(out))

    def best(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of the overlapping spans of one notice, the one with the fewest edits."""
        kept: list[tuple[int, int, int, int]] = []
        for m in found:
            if kept and kept[-1][0] == m[0] and self.notices[m[0]].edits and m[1] < kept[-1][2]:
                if m[3] < kept[-1][3]:
                    kept[-1] = m
            else:
                kept.append(m)
        return kept


@lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``doc_id, n_words, matches``: every match with label, edits, word and character span of the text."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    every = tuple(phrases) + tuple(notices)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(every)
        for batch in batches(parts):
            counts, found = [], []
            for raw in texts(batch.column(1)):
                words = raw.translate(FOLD).split()
                counts.append(len(words))
                text = f" {b' '.join(words).decode('utf-8', 'replace')} "
                hits = scanner.matches(text)
                spans = _characters(raw, text, hits)
                found.append(
                    [
                        {"label": every[i].label, "phrase": every[i].phrase, "exact": not every[i].edits, "edits": edits, "start_word": text.count(" ", 0, s) - 1, "end_word": text.count(" ", 0, e), "start_char": a, "end_char": z}
                        for (i, s, e, edits), (a, z) in zip(hits, spans, strict=True)
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, ARROW)], ["doc_id", "n_words", "matches"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, matches {MATCH}")


ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("phrase", pa.string()), ("exact", pa.bool_()), ("edits", pa.int32()), *((c, pa.int64()) for c in ("start_word", "end_word", "start_char", "end_char"))])
)


def _characters(raw: bytes, text: str, hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The hits' spans in the text as it was given."""
    if not hits:
        return []
    firsts, lasts = [text.count(" ", 0, s) - 1 for _, s, _, _ in hits], [text.count(" ", 0, e) - 1 for _, _, e, _ in hits]
    wanted = {*firsts, *lasts}
    at = {i: m.span() for i, m in enumerate(islice(WORD.finditer(raw.decode("utf-8", "replace")), max(wanted) + 1)) if i in wanted}
    return [(at[a][0], at[z][1]) for a, z in zip(firsts, lasts, strict=True)]


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`'s."""
    base = F.filter("matches", lambda m: m["exact"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    similarity = F.transform("matches", lambda m: F.lit(1.0) - m["edits"] / F.length(m["phrase"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(similarity), F.lit(0.0)).alias("score"),
    )
