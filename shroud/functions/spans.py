"""Find-all-with-offsets as one Spark SQL expression.

Spark has ``regexp_extract_all`` (values) but nothing that returns match
positions.  We get both from a single regex pass: ``regexp_replace`` wraps
every match in a private-use mark, a plain one-character ``split`` cuts the
marked text into ``gap, match, gap, match, ..., gap``, and one running sum
turns the piece lengths into code-point offsets (Spark's ``length`` counts
code points, the same unit as Python string indices).

Two guards keep this exact and cheap:

* ``rlike`` first - longer texts without a hit (the vast majority for every rule)
  cost one scan that stops at the first match and allocate nothing; a short text is
  marked at once, and had no hit if it is as long as before;
* a text that already contains the mark falls back to two passes with the
  same pattern (``split`` for the gaps, ``regexp_extract_all`` for the
  values); both use the same left-to-right ``Matcher.find`` loop, so they
  align for every pattern that cannot match the empty string.

Expressions are generated as SQL text and parsed once by Spark (building
them through the Python Column API costs one JVM round trip per node).
Everything runs in the JVM.  Result type: ``SPAN_TYPE``.
"""

from __future__ import annotations

import os.path

MARK = "\ue000"  # private-use code point; texts containing it take the two-pass path
SPAN_TYPE = "ARRAY<STRUCT<`start`: INT, `end`: INT, `value`: STRING>>"


def lit(s: str) -> str:
    """Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def let(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once, bind it to lambda variable ``var`` in ``body``.

    Higher-order functions are interpreted and get no common-subexpression
    elimination; binding through a one-element ``transform`` pins the value.
    """
    return f"transform(array({value}), {var} -> {body})[0]"


def empty(type_sql: str) -> str:
    return f"CAST(array() AS {type_sql})"


#: Up to so many elements are walked in one level: copies of a short accumulator cost less than a second level.
ONE_LEVEL = 32
#: Pieces of a text with up to four hits.
FEW_PIECES = 9
#: Bytes of a text up to which marking its hits at once costs less than looking for one first.
SHORT_BYTES = 1024


def chunk_width(items: str) -> str:
    """Square root of the number of elements, rounded up; all of a few elements, at least 1."""
    return f"greatest(IF(size({items}) <= {ONE_LEVEL}, size({items}), CAST(ceil(sqrt(size({items}))) AS INT)), 1)"


def chunks(items: str, width: str) -> str:
    """``items`` as consecutive slices of ``width`` (one empty slice if there are none)."""
    return (
        f"transform(sequence(0, greatest(CAST(ceil(size({items}) / {width}) AS INT) - 1, 0)), "
        f"ci_ -> slice({items}, ci_ * {width} + 1, {width}))"
    )


def running(items: str, init: str, step: str, emit: str, out_type: str) -> str:
    """One output per element from a state that runs over ``items``.

    ``emit`` and ``step`` are SQL over the state before the element (``st_``) and
    the element (``x_``).  ``aggregate`` copies its accumulator at every step, so
    the walk has two levels, chunks of square-root size and the elements of one:
    n outputs cost n * sqrt(n) copies instead of n * n.  A few elements take one level.
    """
    emitted = let("si_.s", "st_", f"named_struct('s', {step}, 'o', concat(si_.o, array({emit})))")
    inner = f"aggregate(sc_, named_struct('s', so_.s, 'o', {empty(out_type)}), (si_, x_) -> {emitted})"
    outer = let(inner, "sr_", "named_struct('s', sr_.s, 'o', concat(so_.o, sr_.o))")
    begin = f"named_struct('s', {init}, 'o', {empty(out_type)})"
    few = f"aggregate(sq_, {begin}, (si_, x_) -> {emitted}, si_ -> si_.o)"
    many = let(chunk_width("sq_"), "sw_", f"aggregate({chunks('sq_', 'sw_')}, {begin}, (so_, sc_) -> {outer}, so_ -> so_.o)")
    return let(items, "sq_", f"IF(size(sq_) <= {ONE_LEVEL}, {few}, {many})")


def _from_pieces(pieces: str, before: str) -> str:
    """``[gap, match, gap, ..., gap]`` (``pp_``) -> spans of the odd pieces; with a few hits ``before`` is the text's length before piece ``{}``."""
    few = (
        "transform(sequence(1, size(pp_) - 2, 2), "
        f"i_ -> named_struct('start', {before.format('i_')}, 'end', {before.format('i_ + 1')}, 'value', get(pp_, i_)))"
    )
    many = let(
        running("transform(pp_, e_ -> length(e_))", "0", "st_ + x_", "st_", "ARRAY<INT>"),
        "cc_",
        "transform(sequence(1, size(pp_) - 2, 2), "
        "i_ -> named_struct('start', get(cc_, i_), 'end', get(cc_, i_) + length(get(pp_, i_)), 'value', get(pp_, i_)))",
    )
    return let(pieces, "pp_", f"IF(size(pp_) < 3, {empty(SPAN_TYPE)}, IF(size(pp_) <= {FEW_PIECES}, {few}, {many}))")


def _two_pass(text: str, p: str) -> str:
    """The same pieces from two passes: gaps by ``split``, values by ``regexp_extract_all``."""
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))"
    pairs = f"flatten(transform({zipped}, z_ -> array(z_['0'], coalesce(z_['1'], ''))))"
    return let(pairs, "zp_", _from_pieces("slice(zp_, 1, size(zp_) - 1)", "length(concat_ws('', slice(pp_, 1, {})))"))


def find_all_sql(text: str, pattern: str, needs: tuple[str, ...] = (), guard: str | None = None) -> str:
    """SQL: all non-overlapping matches of Java ``pattern`` in ``text``, left to right."""
    return find_all_of_sql(text, lit(pattern), needs, guard)


def find_all_of_sql(text: str, p: str, needs: tuple[str, ...] = (), guard: str | None = None) -> str:
    """``find_all_sql`` for a pattern given as SQL ``p`` (a literal, or one made per row).

    ``text`` is a SQL expression (usually a quoted column).  The pattern must
    not match the empty string (true for every built-in rule and keyword).
    ``needs``: literals of which every match contains one; texts without any
    skip the regex (a byte search instead of a regex scan).  ``guard``: a SQL
    boolean that is false only for texts without a match (e.g. a per-row
    "contains a digit" column shared by several rules).  Null text -> null.
    """
    pre = f"WHEN NOT {guard} THEN {empty(SPAN_TYPE)} " if guard else ""
    if needs:
        shared = os.path.commonprefix(needs) if len(needs) > 1 else ""
        any_of = " OR ".join(f"contains({text}, {lit(n)})" for n in needs)
        any_of = f"(contains({text}, {lit(shared)}) AND ({any_of}))" if shared else f"({any_of})"
        pre += f"WHEN NOT {any_of} THEN {empty(SPAN_TYPE)} "
    # what stands before a piece is measured with the marks in it, of which there is one for each earlier piece
    marked = _from_pieces(f"split(mk_, {lit(MARK)}, -1)", f"length(substring_index(mk_, {lit(MARK)}, {{0}})) - ({{0}} - 1)")
    found = f"CASE WHEN octet_length(mk_) = octet_length({text}) THEN {empty(SPAN_TYPE)} WHEN contains({text}, {lit(MARK)}) THEN {_two_pass(text, p)} ELSE {marked} END"
    return (
        f"CASE WHEN {text} IS NULL THEN NULL "
        f"{pre}"
        f"WHEN octet_length({text}) > {SHORT_BYTES} AND NOT ({text} RLIKE {p}) THEN {empty(SPAN_TYPE)} "
        f"ELSE {let(f'regexp_replace({text}, {p}, {lit(MARK + chr(36) + chr(48) + MARK)})', 'mk_', found)} END"
    )


def java_quote(literal: str) -> str:
    """Java regex that matches ``literal`` verbatim (``\\Q...\\E`` safe for ``\\E``)."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
