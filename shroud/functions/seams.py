"""Where a text may be cut without touching any hit.

A seam is a character that no active rule can match and no look-around can require.
Cut right behind one, and both pieces give exactly the hits of the whole text: no
match spans the cut, and a look-around meets the text's edge instead of a character
that it treats the same way.  Candidates are ASCII marks without a case, which no
combining mark changes under NFKC, so normalising the pieces is normalising the text.

Which characters a rule can match is read off its parsed pattern, so a user's own
catalogue, regexes and keywords are covered; a pattern that looks for the text's start
or end has no seam at all.
"""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser as parser

from shroud.config import RedactionConfig, valid_python_regexes
from shroud.functions import rules as R

#: No letters, digits or spaces; without "<", "=" and ">", which compose with U+0338.
CANDIDATES = ",;!?\"'[]{}#$&*|~`^"

_REPEATS = {ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT}
_WORD_EDGES = {ops.AT_BOUNDARY, ops.AT_NON_BOUNDARY}


def _touches(tokens, ch: str) -> bool:
    """Whether a parsed pattern can match ``ch``, or the edge of a text, anywhere."""
    for op, arg in tokens:
        if op is ops.LITERAL:
            found = chr(arg) == ch
        elif op is ops.AT:
            found = arg not in _WORD_EDGES
        elif op in _REPEATS:
            found = _touches(arg[2], ch)
        elif op is ops.SUBPATTERN:
            found = _touches(arg[3], ch)
        elif op is ops.ATOMIC_GROUP:
            found = _touches(arg, ch)
        elif op is ops.BRANCH:
            found = any(_touches(branch, ch) for branch in arg[1])
        elif op in (ops.ASSERT, ops.ASSERT_NOT):
            found = _touches(arg[1], ch)
        elif op is ops.GROUPREF_EXISTS:
            found = any(_touches(branch, ch) for branch in arg[1:] if branch is not None)
        elif op is ops.GROUPREF:
            found = False  # repeats what a group matched
        elif op is ops.IN:
            found = _in_class(arg, ch)
        else:  # any character, a negated literal, and whatever else there may be
            found = True
        if found:
            return True
    return False


def _in_class(items, ch: str) -> bool:
    negated = bool(items) and items[0][0] is ops.NEGATE
    found = False
    for op, arg in items[1:] if negated else items:
        if op is ops.LITERAL:
            found |= chr(arg) == ch
        elif op is ops.RANGE:
            found |= arg[0] <= ord(ch) <= arg[1]
        elif op is ops.CATEGORY:  # the candidates are no words, digits or spaces
            found |= arg in (ops.CATEGORY_NOT_WORD, ops.CATEGORY_NOT_DIGIT, ops.CATEGORY_NOT_SPACE)
    return found != negated


def may_touch(pattern: str, ch: str) -> bool:
    return _touches(parser.parse(pattern, re.IGNORECASE), ch)


def seams(config: RedactionConfig | None = None) -> str:
    """The seams of a configuration, perhaps none."""
    config = config or RedactionConfig()
    rules = [r.regex for r in R.PII_RULES + R.secret_rules(config.catalogue) + R.LOCATION_RULES if config.enabled(*r.toggles)]
    words = ""
    if config.custom_active:
        rules += valid_python_regexes(config.custom_regex)
        words = "".join(config.custom_keywords)
    return "".join(ch for ch in CANDIDATES if ch not in words and not any(may_touch(rx, ch) for rx in rules))


def cut(text: str, at_seam: re.Pattern, size: int):
    """``text`` in pieces of ``size`` characters or more, each but the last ending with a seam."""
    start = 0
    while len(text) - start > size:
        found = at_seam.search(text, start + size - 1)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    if start < len(text) or not text:
        yield text[start:]


def seam_pattern(chars: str) -> re.Pattern:
    return re.compile("[" + re.escape(chars) + "]")
