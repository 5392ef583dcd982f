"""Detectors (D1-D18) and the candidate list (R1), all as per-row array columns.

Each detector is a find-all scan followed by a filter on the hit (a rejected
hit still consumed its text, so the filter runs after the scan).  Candidates
of all detectors are concatenated in emission order into one
``array<candidate>`` column.  No shuffle, no Python worker (except the
optional custom-regex UDF), so the same projection serves batch and streams.

Expressions are SQL text (see ``functions.spans``); each detector becomes one
column of one projection, so every regex runs once per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.config import RedactionConfig, valid_python_regexes
from shroud.functions import many_rules
from shroud.functions import rules as R
from shroud.functions.custom_regex import custom_regex_spans
from shroud.functions.spans import SPAN_TYPE, empty, find_all_of_sql, find_all_sql, ident, java_quote, let, lit

CAND_STRUCT = (
    "STRUCT<`start`: INT, `end`: INT, `entity_type`: STRING, `value`: STRING, `category`: STRING, "
    "`source`: STRING, `priority`: INT, `emission`: INT>"
)
CAND_TYPE = f"ARRAY<{CAND_STRUCT}>"
MATCH_TYPE = (
    "ARRAY<STRUCT<`start`: INT, `end`: INT, `entity_type`: STRING, `value`: STRING, `category`: STRING, `source`: STRING>>"
)
NER_TYPE = "ARRAY<STRUCT<`start`: INT, `end`: INT, `label`: STRING>>"

_ND_FROM, _ND_TO = R.unicode_decimal_digits()


def ascii_digits_sql(value: str) -> str:
    """Map every Unicode decimal digit to its ASCII digit (Python's ``int`` does the same)."""
    return f"translate({value}, {lit(_ND_FROM)}, {lit(_ND_TO)})"


def _phone_ok(v: str) -> str:
    """Not an SSN as a whole, and 7-15 digits."""
    ssn_whole = lit("^" + R.java_pattern(R.SSN_RE) + "\\z")
    n = f"length(regexp_replace({v}, {lit(chr(92) + 'P{Nd}')}, ''))"
    return f"(NOT ({v} RLIKE {ssn_whole}) AND {n} BETWEEN {R.PHONE_MIN_DIGITS} AND {R.PHONE_MAX_DIGITS})"


def _card_ok(v: str) -> str:
    """13-19 digits and a valid Luhn checksum."""
    digits = f"regexp_replace({ascii_digits_sql(v)}, '[^0-9]', '')"
    return let(digits, "d_", f"(length(d_) BETWEEN {R.CARD_MIN_DIGITS} AND {R.CARD_MAX_DIGITS} AND luhn_check(d_))")


def _ipv4_ok(v: str) -> str:
    """Every dotted part is 0-255."""
    return f"forall(split({ascii_digits_sql(v)}, '[.]', -1), o_ -> try_cast(o_ AS INT) <= {R.IPV4_MAX_OCTET})"


POST_FILTERS = {"phone": _phone_ok, "card": _card_ok, "ipv4": _ipv4_ok}


HAS_DIGIT = "\\p{Nd}"  # any Unicode decimal digit


def rule_spans_sql(text: str, rule: R.Rule, digit_guard: str | None = None) -> str:
    """SQL ``SPAN_TYPE`` of one built-in rule, post-filtered (and narrowed to group 1).

    ``digit_guard``: SQL boolean "text contains a decimal digit", computed once
    per row and shared by every rule whose hits always contain a digit.
    """
    guard = (digit_guard or f"({text} RLIKE {lit(HAS_DIGIT)})") if rule.digit else None
    if rule.holds:
        guard = f"({text} RLIKE {lit(rule.holds)})"
    spans = find_all_sql(text, rule.java, rule.needs, guard)
    if rule.check:
        spans = f"filter({spans}, s_ -> {POST_FILTERS[rule.check]('s_.value')})"
    if rule.group == 1:
        # The capture group ends the pattern, so it ends where the match ends.
        narrowed = let(
            f"regexp_extract(s_.value, {lit(rule.java)}, 1)",
            "g_",
            "named_struct('start', s_.`end` - length(g_), 'end', s_.`end`, 'value', g_)",
        )
        spans = f"filter(transform({spans}, s_ -> {narrowed}), s_ -> s_.start < s_.`end`)"
    return spans


def rule_spans(text_col: str, rule: R.Rule) -> Column:
    return F.expr(rule_spans_sql(ident(text_col), rule))


def keyword_pattern(keyword: str) -> str:
    """Whole-word, case-insensitive literal; its first letter is looked for first."""

    def word(ch: str) -> bool:  # only letters match an ASCII letter, whatever the case
        return ch.isascii() and (ch.isalnum() or ch == "_")

    before = f"(?={keyword[0]})" + R.WORD_STARTS if word(keyword[0]) else R.BOUNDARY
    return "(?iu)" + before + java_quote(keyword) + (R.WORD_ENDS if word(keyword[-1]) else R.BOUNDARY)


def _tag(spans: str, entity_type: str, category: str, emission: int | str, source: str | None = None) -> str:
    priority = R.CATEGORY_PRIORITY.get(category, R.UNKNOWN_PRIORITY)
    src = lit(source or category)
    return (
        f"transform({spans}, t_ -> named_struct('start', t_.start, 'end', t_.`end`, 'entity_type', {lit(entity_type)}, "
        f"'value', t_.value, 'category', {lit(category)}, 'source', {src}, 'priority', {priority}, 'emission', {emission}))"
    )


def _ner_candidates(text: str, ner: str, config: RedactionConfig) -> list[str]:
    """External NER spans ``NER_TYPE`` -> PERSON / LOCATION candidates."""
    out = []
    groups = []
    if config.enabled("names"):
        groups.append((R.NER_PERSON_LABELS, "PERSON", "pii", R.NER_PERSON_EMISSION))
    if config.enabled("addresses"):
        groups.append((R.NER_LOCATION_LABELS, "LOCATION", "location", R.NER_LOCATION_EMISSION))
    for labels, etype, cat, emission in groups:
        label_list = ", ".join(lit(x) for x in labels)
        picked = (
            f"filter(coalesce({ner}, {empty(NER_TYPE)}), n_ -> upper(n_.label) IN ({label_list}) "
            f"AND n_.start >= 0 AND n_.start < n_.`end` AND n_.`end` <= length({text}))"
        )
        spans = (
            f"transform({picked}, n_ -> named_struct('start', n_.start, 'end', n_.`end`, "
            f"'value', substring({text}, n_.start + 1, n_.`end` - n_.start)))"
        )
        out.append(_tag(spans, etype, cat, emission))
    return out


def long_catalogue(config: RedactionConfig) -> list[tuple[str, str]]:
    """The catalogue's rules, if they are searched by one automaton (or in Python's own syntax for named groups)."""
    rules = R.valid_catalogue(config.catalogue or []) if config.enabled("api_keys") else []
    return rules if len(rules) >= many_rules.MANY or any("(?P" in rx for _, rx in rules) else []


def long_keywords(config: RedactionConfig) -> list[str]:
    """The keywords, if they are searched by one automaton."""
    words = [k for k in config.custom_keywords if k] if config.custom_active else []
    return words if len(words) >= many_rules.MANY else []


def detector_sql(
    text: str, config: RedactionConfig, ner: str | None = None, digit_guard: str | None = None
) -> list[tuple[str, str]]:
    """(name, SQL of the tagged candidate array) per active native detector, emission order.

    Detectors whose category switch is off are pruned from the plan (the
    reference filters their matches before resolution; same result, less work).
    Custom regexes (a Python UDF) are added separately by ``with_candidates``.
    """
    cols: list[tuple[str, str]] = []
    secrets = [] if long_catalogue(config) else R.secret_rules(config.catalogue)
    rules = R.PII_RULES + secrets + R.LOCATION_RULES
    for rule in rules:
        if rule.entity_type == "PERSON" and ner is not None:
            continue  # an NER span table replaces the name pattern
        if not config.enabled(*rule.toggles):
            continue
        spans = rule_spans_sql(text, rule, digit_guard)
        cols.append((rule.entity_type, _tag(spans, rule.entity_type, rule.category, rule.emission)))
    if ner is not None:
        for i, c in enumerate(_ner_candidates(text, ner, config)):
            cols.append((f"NER{i}", c))
    if config.custom_active and not long_keywords(config):
        base = R.CUSTOM_EMISSION_BASE + len(valid_python_regexes(config.custom_regex))
        for j, kw in enumerate(k for k in config.custom_keywords if k):
            cols.append((f"KW{j}", _tag(find_all_sql(text, keyword_pattern(kw)), "CUSTOM", "custom", base + j)))
    return cols


def _custom_regex_tagged(spans_col: str) -> str:
    return (
        f"transform({spans_col}, c_ -> named_struct('start', c_.start, 'end', c_.`end`, 'entity_type', 'CUSTOM', "
        f"'value', c_.value, 'category', 'custom', 'source', 'custom', 'priority', {R.CATEGORY_PRIORITY['custom']}, "
        f"'emission', {R.CUSTOM_EMISSION_BASE} + c_.rule))"
    )


def with_candidates(
    df: DataFrame, text_col: str, config: RedactionConfig, ner_col: str | None = None, out_col: str = "cands"
) -> DataFrame:
    """Add ``out_col``: all candidates of the active detectors (R1), emission order."""
    text = ident(text_col)
    ner = ident(ner_col) if ner_col else None
    keep = [F.col(c) for c in df.columns]
    # one "has a digit" scan per row, shared by the seven digit-bearing rules
    df = df.select(*keep, F.expr(f"{text} RLIKE {lit(HAS_DIGIT)}").alias("__has_digit"))
    dets = detector_sql(text, config, ner, digit_guard="`__has_digit`")
    names = [f"__det_{i}" for i in range(len(dets))]
    cols = [F.expr(sql).alias(n) for n, (_, sql) in zip(names, dets)]
    regexes = valid_python_regexes(config.custom_regex) if config.custom_active else []
    order = list(names)
    if regexes:
        # User regexes run in Python (Arrow batches); in emission order they
        # come after the native rules and before the keywords.
        cols.append(custom_regex_spans(F.col(text_col), regexes).alias("__det_rx"))
        kw = [n for n, (name, _) in zip(names, dets) if name.startswith("KW")]
        order = [n for n in names if n not in kw] + ["__det_rx"] + kw
    if rules := long_catalogue(config):
        many = many_rules.candidates(F.col(text_col), many_rules.of_catalogue(rules), "secrets", R.LONG_CATALOGUE_EMISSION, False, CAND_TYPE)
        cols.append(many.alias("__det_cat"))
        order.append("__det_cat")
    if words := long_keywords(config):
        base = R.CUSTOM_EMISSION_BASE + len(regexes)
        cols.append(many_rules.candidates(F.col(text_col), many_rules.of_keywords(words), "custom", base, True, CAND_TYPE).alias("__det_words"))
        order.append("__det_words")
    df = df.select(*keep, *cols)
    parts = []
    for n in order:
        col_sql = _custom_regex_tagged(ident(n)) if n == "__det_rx" else ident(n)
        parts.append(f"coalesce({col_sql}, {empty(CAND_TYPE)})")
    body = f"concat({', '.join(parts)})" if parts else empty(CAND_TYPE)
    cands = F.expr(f"CASE WHEN {text} IS NULL THEN NULL ELSE CAST({body} AS {CAND_TYPE}) END")
    return df.select(*keep, cands.alias(out_col))


def row_keyword_candidates_sql(text: str, keywords: str, config: RedactionConfig) -> str:
    """Candidates of the row's own keywords (D14), after those of ``config`` in list order."""
    first = R.CUSTOM_EMISSION_BASE + len(valid_python_regexes(config.custom_regex)) + len(config.custom_keywords)
    quoted = f"replace(kw_, {lit(chr(92) + 'E')}, {lit(java_quote(chr(92) + 'E')[2:-2])})"
    # as in ``keyword_pattern``: a keyword's pattern is compiled for its row, so it is kept small
    before = f"IF(kw_ RLIKE '^[A-Za-z0-9_]', concat('(?=', left(kw_, 1), {lit(')' + R.WORD_STARTS)}), {lit(R.BOUNDARY)})"
    after = f"IF(kw_ RLIKE {lit('[A-Za-z0-9_]' + chr(92) + 'z')}, {lit(R.WORD_ENDS)}, {lit(R.BOUNDARY)})"
    pattern = f"concat('(?iu)', {before}, {lit(chr(92) + 'Q')}, {quoted}, {lit(chr(92) + 'E')}, {after})"
    per_word = let(pattern, "kp_", _tag(find_all_of_sql(text, "kp_"), "CUSTOM", "custom", f"{first} + kn_"))
    return f"flatten(transform(filter({keywords}, kw_ -> kw_ <> ''), (kw_, kn_) -> {per_word}))"


def row_toggle_sql(toggles: str, *names: str) -> str:
    """Whether switches are on in the row's own map; an absent switch has its default."""
    return " AND ".join(f"coalesce(try_element_at({toggles}, {lit(n)}), {str(R.DEFAULT_TOGGLES[n]).upper()})" for n in names)


def row_toggle_filter_sql(cands: str, toggles: str) -> str:
    """Candidates whose category switches are on in the row's own map (F2); an absent switch has its default."""
    on = lambda *names: row_toggle_sql(toggles, *names)
    types: dict[tuple[str, ...], list[str]] = {}
    for t, names in R.TOGGLES_BY_TYPE.items():
        types.setdefault(names, []).append(lit(t))
    by_type = " ".join(f"WHEN f_.entity_type IN ({', '.join(ts)}) THEN {on(*names)}" for names, ts in types.items())
    cond = f"CASE WHEN f_.category = 'custom' THEN {on('custom')} WHEN f_.category = 'secrets' THEN {on('api_keys')} {by_type} ELSE TRUE END"
    kept = f"filter({cands}, f_ -> {cond})"
    return f"IF({toggles} IS NULL, {cands}, {kept})" if all(R.DEFAULT_TOGGLES.values()) else kept


def dedupe_candidates_sql(cands: str) -> str:
    """Detector-level de-duplication (D17, D18) for the candidates view.

    Keeps the first candidate per (start, end, entity_type) within pii and
    within location, and per (start, end) within custom.  Resolution gives the
    same result with or without it; it only matters for the raw view.
    """
    key = (
        "named_struct('start', c_.start, 'end', c_.`end`, 'group', CASE WHEN c_.category = 'custom' THEN 'custom' "
        "WHEN c_.category IN ('pii', 'location') THEN concat(c_.category, ' ', c_.entity_type) "
        "ELSE concat('# ', CAST(i_ AS STRING)) END)"
    )
    # sorted by (key, position), the first of each run of equal keys stays
    ranked = f"sort_array(transform(cs_, (c_, i_) -> named_struct('k', {key}, 'i', i_)))"
    kept = "transform(filter(rk_, (a_, n_) -> n_ = 0 OR a_.k <> get(rk_, n_ - 1).k), a_ -> a_.i)"
    return let(cands, "cs_", let(ranked, "rk_", f"transform(sort_array({kept}), a_ -> get(cs_, a_))"))


def as_matches_sql(cands: str) -> str:
    """Candidate structs -> public match structs (drop ranking fields)."""
    return (
        f"transform({cands}, m_ -> named_struct('start', m_.start, 'end', m_.`end`, 'entity_type', m_.entity_type, "
        f"'value', m_.value, 'category', m_.category, 'source', m_.source))"
    )
