"""Rewrite (R5-R10) and per-text maps (A1, A2, A5), as per-row expressions.

Input: the normalised text and the selected, disjoint matches sorted by start.
One running walk over the matches gives token numbers per prefix and output
offsets; the redacted text is then the ``array_join`` of ``gap + token`` pieces
and the tail.  No shuffle.
"""

from __future__ import annotations

from shroud.functions import rules as R
from shroud.functions.spans import chunk_width, chunks, empty, let, lit, running

REPLACEMENT_NAMES = (
    "original_start", "original_end", "output_start", "output_end",
    "token", "original_value", "entity_type", "category",
)
REPLACEMENT_STRUCT = (
    "STRUCT<`original_start`: INT, `original_end`: INT, `output_start`: INT, `output_end`: INT, "
    "`token`: STRING, `original_value`: STRING, `entity_type`: STRING, `category`: STRING>"
)
REPLACEMENT_TYPE = f"ARRAY<{REPLACEMENT_STRUCT}>"


def token_prefix_sql(entity_type: str) -> str:
    """Upper case, runs outside ``A-Z0-9`` -> ``_``, strip ``_``; empty -> REDACTED.  The built-in types are their own prefix."""
    known = ", ".join(lit(t) for t in [*R.TOGGLES_BY_TYPE, "CUSTOM"])
    raw = f"regexp_replace(upper({entity_type}), '[^A-Z0-9]+', '_')"
    return f"IF({entity_type} IN ({known}), {entity_type}, coalesce(nullif(regexp_replace({raw}, '^_+|_+$', ''), ''), {lit(R.FALLBACK_PREFIX)}))"


_COUNTS_TYPE = "ARRAY<STRUCT<`p`: STRING, `n`: INT>>"
#: Hits of a text up to which each looks at all before it.
FEW_HITS = 8


def _work(selected: str, given: str) -> str:
    """Replacement records (+ prefix) for matches sorted by start; ``given``: numbers per prefix that went out before.

    One running walk over many hits carries only integers - the output shift
    before each hit and its token number (from a tiny per-prefix counter); the
    records, with their strings, are then built by one ``transform``.
    """
    num = "coalesce(try_element_at(filter(st_.counts, c_ -> c_.p = x_.p), 1).n, 0) + 1"
    counts = (
        "IF(exists(st_.counts, c_ -> c_.p = x_.p), "
        "transform(st_.counts, c_ -> IF(c_.p = x_.p, named_struct('p', c_.p, 'n', c_.n + 1), c_)), "
        "concat(st_.counts, array(named_struct('p', x_.p, 'n', 1))))"
    )
    step = (
        f"named_struct('delta', st_.delta + length(x_.p) + length(CAST({num} AS STRING)) + 3 - x_.len, 'counts', {counts})"
    )
    hits = f"transform(ms_, m_ -> named_struct('p', {token_prefix_sql('m_.entity_type')}, 'len', m_.`end` - m_.start))"
    walk = running(
        hits,
        f"named_struct('delta', 0, 'counts', CAST({given} AS {_COUNTS_TYPE}))",
        step,
        f"named_struct('num', {num}, 'delta', st_.delta, 'p', x_.p)",
        "ARRAY<STRUCT<`num`: INT, `delta`: INT, `p`: STRING>>",
    )
    rec = (
        "named_struct('original_start', m_.start, 'original_end', m_.`end`, "
        "'output_start', m_.start + u_.delta, 'output_end', m_.start + u_.delta + length(t_), "
        "'token', t_, 'original_value', m_.value, 'entity_type', m_.entity_type, 'category', m_.category, 'prefix', u_.p)"
    )
    per_hit = let("get(wk_, i_)", "u_", let("concat('[', u_.p, '_', CAST(u_.num AS STRING), ']')", "t_", rec))
    many = let(walk, "wk_", f"transform(ms_, (m_, i_) -> {per_hit})")
    # of a few hits each counts those of its prefix up to itself, and adds up what the tokens before it shift
    before = "" if given == "array()" else f"coalesce(try_element_at(filter(CAST({given} AS {_COUNTS_TYPE}), c_ -> c_.p = p_), 1).n, 0) + "
    tokens = f"transform(ps_, (p_, i_) -> concat('[', p_, '_', CAST({before}size(filter(slice(ps_, 1, i_ + 1), y_ -> y_ = p_)) AS STRING), ']'))"
    shifts = "transform(ts_, (t_, i_) -> length(t_) - get(ms_, i_).`end` + get(ms_, i_).start)"
    short = (
        "transform(ms_, (m_, i_) -> named_struct('original_start', m_.start, 'original_end', m_.`end`, 'output_start', m_.start + get(ds_, i_), "
        "'output_end', m_.start + get(ds_, i_) + length(get(ts_, i_)), 'token', get(ts_, i_), 'original_value', m_.value, "
        "'entity_type', m_.entity_type, 'category', m_.category, 'prefix', get(ps_, i_)))"
    )
    deltas = "transform(sh_, (d_, i_) -> aggregate(slice(sh_, 1, i_), 0, (a_, b_) -> a_ + b_))"
    few = let(f"transform(ms_, m_ -> {token_prefix_sql('m_.entity_type')})", "ps_", let(tokens, "ts_", let(shifts, "sh_", let(deltas, "ds_", short))))
    return let(selected, "ms_", f"IF(size(ms_) <= {FEW_HITS}, {few}, {many})")


def count_map_sql(keys: str) -> str:
    """map key -> occurrences, keys in first-seen order."""
    return let(keys, "ks_", "map_from_entries(transform(array_distinct(ks_), k_ -> named_struct('key', k_, 'value', size(filter(ks_, y_ -> y_ = k_)))))")


def work_sql(selected: str, given: str = "array()") -> str:
    """SQL array of replacement records with their prefix; null for null.

    ``given``: array of (prefix, number) that went out before this text, where it is a piece of a longer one.
    """
    return f"CASE WHEN {selected} IS NULL THEN NULL ELSE {_work(selected, given)} END"


def redacted_text_sql(text: str, work: str) -> str:
    """The text with ``work_sql``'s tokens in place of their values."""
    # substring walks its text from the front: cut each chunk of hits out first, then its gaps
    gap_from = "IF(i_ = 0, from_, get(q_, i_ - 1).original_end)"
    pieces = (
        f"transform(q_, (r_, i_) -> concat(substring(part_, {gap_from} - from_ + 1, "
        f"r_.original_start - {gap_from}), r_.token))"
    )
    part = f"substring({text}, from_ + 1, try_element_at(q_, -1).original_end - from_)"
    joined = let("coalesce(get(rs_, j_ * w_ - 1).original_end, 0)", "from_", let(part, "part_", f"array_join({pieces}, '')"))
    body_text = let(chunk_width("rs_"), "w_", f"array_join(transform({chunks('rs_', 'w_')}, (q_, j_) -> {joined}), '')")
    tail_from = "coalesce(try_element_at(rs_, -1).original_end, 0)"
    redacted = let(work, "rs_", f"concat({body_text}, substring({text}, {tail_from} + 1))")
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN size({work}) = 0 THEN {text} ELSE {redacted} END"


def replacements_sql(work: str) -> str:
    """``work_sql`` without the prefixes."""
    return f"transform({work}, r_ -> named_struct(" + ", ".join(f"'{n}', r_.{n}" for n in REPLACEMENT_NAMES) + "))"


def token_to_original_sql(work: str) -> str:
    return f"map_from_entries(transform({work}, r_ -> named_struct('key', r_.token, 'value', r_.original_value)))"


#: What a token looks like.
TOKEN_RE = "\\[[A-Z0-9_]+_[0-9]+\\]"
#: Replacements of a row from which on the text is cut at its tokens once.
ONE_PASS_FROM = 24


def _token_by_token(text: str, replacements: str) -> str:
    order = (
        f"sort_array(transform({replacements}, "
        f"(r_, i_) -> named_struct('k', -length(r_.token), 'i', i_, 't', r_.token, 'v', r_.original_value)))"
    )
    return f"aggregate({order}, {text}, (acc_, r_) -> replace(acc_, r_.t, r_.v))"


def _one_pass(text: str, replacements: str) -> str:
    """The text cut at its tokens, each looked up once.

    Replacements and the text's tokens are sorted together by token; a running walk
    gives each token of the text the first replacement of its name, as one long
    (place in the text above place in the list + 1).
    """
    pattern = lit(TOKEN_RE)
    known = f"transform({replacements}, (r_, i_) -> named_struct('t', r_.token, 'kind', 0, 'i', i_))"
    met = "transform(toks_, (t_, i_) -> named_struct('t', t_, 'kind', 1, 'i', i_))"
    same = "(st_ >= 0 AND get(mg_, st_).t = get(mg_, x_).t)"
    walk = running(
        "sequence(0, size(mg_) - 1)",
        "-1",
        f"IF(get(mg_, x_).kind = 0 AND NOT {same}, x_, st_)",
        f"IF(get(mg_, x_).kind = 0, -1L, (CAST(get(mg_, x_).i AS BIGINT) * 4294967296L) | CAST(IF({same}, get(mg_, st_).i + 1, 0) AS BIGINT))",
        "ARRAY<BIGINT>",
    )
    found = let(f"sort_array(concat({known}, {met}))", "mg_", f"sort_array(filter({walk}, w_ -> w_ >= 0))")
    value = f"IF(f_ & 4294967295L = 0, get(toks_, i_), get({replacements}, CAST(f_ & 4294967295L AS INT) - 1).original_value)"
    joined = f"array_join(transform({found}, (f_, i_) -> concat({value}, get(gaps_, i_ + 1))), '')"
    # array_join takes the gaps' texts as they are; a null value stays a null result, as in a replacement
    body = f"concat(get(gaps_, 0), IF(size(toks_) = 0, '', {joined}))"
    return let(f"split({text}, {pattern}, -1)", "gaps_", let(f"regexp_extract_all({text}, {pattern}, 0)", "toks_", body))


def restore_sql(text: str, replacements: str) -> str:
    """Replace every token by its value, longest token first, stable by position.

    Works on the redacted text or on an edited copy of it.  A literal token
    already present in the input, or a restored value that contains a later
    token, is replaced too (same behaviour as the reference).

    With many replacements the text is cut at its tokens once.  That differs from the
    order above only where a value, or a value with what stands around it, shows a
    token that is still to be replaced; the result then shows one of the row's tokens,
    and such rows (and tokens of another form, and null values) go token by token.
    """
    tokens = "transform(reps_, r_ -> r_.token)"
    plain = f"forall(reps_, r_ -> r_.original_value IS NOT NULL AND regexp_like(r_.token, {lit('^' + TOKEN_RE + '$')}))"
    slow = _token_by_token("given_", "reps_")
    clean = f"NOT arrays_overlap(regexp_extract_all(once_, {lit(TOKEN_RE)}, 0), {tokens})"
    fast = let(_one_pass("given_", "reps_"), "once_", f"IF({clean}, once_, {slow})")
    body = f"CASE WHEN given_ IS NULL THEN NULL WHEN size(reps_) < {ONE_PASS_FROM} THEN {slow} WHEN {plain} THEN {fast} ELSE {slow} END"
    # both inputs are named once: where a filter is pushed below the projection that makes them, they are made once
    return let(text, "given_", let(f"coalesce({replacements}, {empty(REPLACEMENT_TYPE)})", "reps_", body))
