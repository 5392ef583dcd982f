"""Overlap resolution (R2-R4) as a per-row array expression.

Greedy choice: candidates ranked by (longer first, category priority, start,
emission order); a candidate is kept if it overlaps no kept one (half-open
spans: touching spans do not overlap); the kept set is returned by start.

Pure projection, no shuffle.  The greedy loop runs inside islands of overlapping
hits only, and within one looks at a candidate's two neighbours among the kept
spans; candidates that are already pairwise disjoint are returned as they are.
"""

from __future__ import annotations

from shroud.functions.spans import let, running


def _greedy(by_start: str) -> str:
    """Greedy selection over ``by_start``, best rank first.

    The kept spans are disjoint, so a list of them in order of start decides by its
    two neighbours whether a candidate fits: its place is found by halving.  An entry
    is one long, start above index, so that copying the list costs little.
    """
    ranked = (
        f"sort_array(transform({by_start}, (r_, i_) -> named_struct('neg_len', r_.start - r_.`end`, "
        f"'priority', r_.priority, 'start', r_.start, 'emission', r_.emission, 'i', i_)))"
    )
    entry = lambda k: f"get({by_start}, CAST({k} & 4294967295L AS INT))"
    halve = let(
        "(b_.lo + b_.hi) DIV 2",
        "mid_",
        "IF(b_.lo >= b_.hi, b_, IF(shiftright(get(k_, CAST(mid_ AS INT)), 32) <= x_.start, "
        "named_struct('lo', mid_ + 1, 'hi', b_.hi), named_struct('lo', b_.lo, 'hi', mid_)))",
    )
    place = "aggregate(steps_, named_struct('lo', 0L, 'hi', CAST(size(k_) AS BIGINT)), (b_, s_) -> " + halve + ", b_ -> CAST(b_.lo AS INT))"
    before, after = entry("get(k_, at_ - 1)"), "shiftright(get(k_, at_), 32)"
    blocked = f"(coalesce({before}.`end` > x_.start, FALSE) OR coalesce({after} < x_.start - x_.neg_len, FALSE))"
    put = "array_insert(k_, at_ + 1, (CAST(x_.start AS BIGINT) * 4294967296L) | CAST(x_.i AS BIGINT))"
    step = f"(k_, x_) -> {let(place, 'at_', f'IF({blocked}, k_, {put})')}"
    steps = f"sequence(1, CAST(ceil(log2(size({by_start}) + 1)) AS INT))"
    kept = let(steps, "steps_", f"aggregate({ranked}, CAST(array() AS ARRAY<BIGINT>), {step})")
    return f"transform({kept}, a_ -> {entry('a_')})"


def _by_islands() -> str:
    """Greedy selection island by island over ``b_`` (sorted by start).

    An island begins where a hit starts at or after the end of all before it;
    hits of two islands never overlap, so each is resolved by itself.
    """
    ends_before = running("transform(b_, e_ -> e_.`end`)", "0", "greatest(st_, x_)", "st_", "ARRAY<INT>")
    # of two that overlap the better one stays, at a draw the first
    rank = lambda i: f"get(g_, {i}).start - get(g_, {i}).`end`, get(g_, {i}).priority, get(g_, {i}).start, get(g_, {i}).emission"
    better = f"slice(g_, IF(struct({rank(0)}) <= struct({rank(1)}), 1, 2), 1)"
    island = let(
        "slice(b_, f_ + 1, coalesce(get(fs_, j_ + 1), size(b_)) - f_)", "g_", f"IF(size(g_) = 1, g_, IF(size(g_) = 2, {better}, {_greedy('g_')}))"
    )
    firsts = let(ends_before, "mx_", "filter(sequence(0, size(b_) - 1), n_ -> get(b_, n_).start >= get(mx_, n_))")
    return let(firsts, "fs_", f"flatten(transform(fs_, (f_, j_) -> {island}))")


def resolve_sql(cands: str) -> str:
    """Selected, disjoint candidates sorted by start (null in -> null out)."""
    disjoint = (
        "(size(b_) < 2 OR forall(sequence(1, greatest(size(b_) - 1, 1)), "
        "j_ -> get(b_, j_).start >= get(b_, j_ - 1).`end`))"
    )
    return let(
        f"sort_array(filter({cands}, c_ -> c_.start < c_.`end`))",
        "b_",
        f"CASE WHEN b_ IS NULL THEN NULL WHEN {disjoint} THEN b_ ELSE {_by_islands()} END",
    )
