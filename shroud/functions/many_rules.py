"""Catalogues and keyword lists of hundreds of rules and more.

A column for each rule costs every text a search for each rule.  Here one automaton of
all rules' literals reads the text once, and only the rules whose literal it holds
(and those without one) are searched.  Python's ``re`` does the searching, the
dialect the rules are written in, in one Arrow-batched UDF; ranking and rewriting stay
in the JVM.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as ops
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shroud.functions import rules as R

#: Rules from which on a list is searched this way.
MANY = 64


def literal(pattern: str) -> str:
    """The longest text that every match of a case-sensitive pattern holds, perhaps none."""
    runs, run = [""], ""

    def walk(tokens) -> None:
        nonlocal run
        for op, arg in tokens:
            if op is ops.LITERAL:
                run += chr(arg)
                runs.append(run)
            elif op is ops.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])
            elif op is not ops.AT:
                run = ""

    tree = parser.parse(pattern)
    if not tree.state.flags & re.IGNORECASE:
        walk(tree)
    return max(runs, key=len)


def folded(text: str) -> str:
    """Characters that a case-insensitive pattern takes for each other become the same."""
    return text.casefold().replace("i̇", "i").replace("ı", "i")


def keyword_regex(keyword: str) -> str:
    return rf"\b{re.escape(keyword)}\b"


@lru_cache(maxsize=4)
def _prepared(patterns: tuple[str, ...], literals: tuple[str, ...], flags: int):
    import ahocorasick

    automaton, always = ahocorasick.Automaton(), []
    for i, word in enumerate(literals):
        if word:
            automaton.add_word(word, (automaton.get(word, ()) if automaton.exists(word) else ()) + (i,))
        else:
            always.append(i)
    if len(automaton):
        automaton.make_automaton()
    return automaton, always, {}


def hits(text: str, patterns: tuple[str, ...], literals: tuple[str, ...], ignore_case: bool) -> list[tuple[int, int, int]]:
    """(rule, start, end) of every match that is not empty, rule by rule."""
    flags = re.IGNORECASE if ignore_case else 0
    automaton, always, compiled = _prepared(patterns, literals, flags)
    wanted = set(always)
    if len(automaton):
        for _, rules in automaton.iter(folded(text) if ignore_case else text):
            wanted.update(rules)
    out = []
    for i in sorted(wanted):
        rx = compiled.get(i) or compiled.setdefault(i, re.compile(patterns[i], flags))
        out += [(i, *m.span()) for m in rx.finditer(text) if m.end() > m.start()]
    return out


def candidates(text: Column, rules: list[tuple[str, str, str]], category: str, first_emission: int, ignore_case: bool, cand_type: str) -> Column:
    """The candidates of ``(entity_type, pattern, literal)`` rules."""
    names, patterns, literals = (tuple(r[i] for r in rules) for i in range(3))
    priority = R.CATEGORY_PRIORITY[category]

    @F.pandas_udf(cand_type)
    def found(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            return [
                {"start": s, "end": e, "entity_type": names[i], "value": t[s:e], "category": category, "source": category, "priority": priority, "emission": first_emission + i}
                for i, s, e in hits(t, patterns, literals, ignore_case)
            ]

        return pd.Series([one(t) for t in texts])

    return found(text)


def of_catalogue(catalogue: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    return [(str(name).upper(), rx, literal(rx)) for name, rx in catalogue]


def of_keywords(keywords: list[str]) -> list[tuple[str, str, str]]:
    return [("CUSTOM", keyword_regex(k), folded(k)) for k in keywords]
