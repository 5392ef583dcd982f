"""Winnowing, whitening and ball-tree search against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import ball_tree, norm_topk, queries, whitening, winnowing

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows(text):
    w = words(text)
    m = min(10, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()


def contaminated(text, items):
    w, hit, found = words(text), set(), set()
    for item, own in items:
        for i in range(len(w)):
            for m in {len(x) for x in own}:
                if tuple(w[i : i + m]) in own:
                    hit |= set(range(i, i + m))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def with_clashes(frame):
    for name in ("hits", "row", "h", "pos", "salt", "cls", "items", "spans", "query", "rank", "score", "term", "df", "dim", "x", "component", "n"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def random_text(rng, vocabulary, n):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))


def test_op11_query(spark):
    items = [(r.item_id, windows(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_winnowing(spark, SF).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got:
        assert contaminated(docs[r.doc_id], items) == tuple(r)[1:]


@pytest.mark.parametrize("broadcast_rows", [0, winnowing.BROADCAST_ROWS])
def test_op11_awkward_rows(spark, broadcast_rows):
    """Few words, so that grams repeat; short items of one to nine words; equal items; null ids and texts."""
    rng = random.Random(5)
    vocabulary = ["Ab", "ab", "cde", "é1", "x9", "ÄÖ", "7"]
    item_texts = [random_text(rng, vocabulary, n) for n in (1, 3, 5, 7, 9, 10, 11, 14, 25, 40)] + ["zz q", "", None, " .,", "solo"]
    items = [*enumerate(item_texts), (3, item_texts[6]), (100, item_texts[8]), (None, "only mine here")]
    texts = [random_text(rng, vocabulary, n) for n in (0, 1, 4, 9, 10, 12, 60, 300)]
    texts += [None, "", "a solo b", "zz", "q zz q", item_texts[9] + " end", "x " + (item_texts[8] or ""), "yes only mine here", "wort " * 5000, "ab " * 500]
    docs = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7])]
    got = winnowing.digest(winnowing.decontaminate(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), with_clashes(spark.createDataFrame(items, "item_id long, text string")), broadcast_rows=broadcast_rows)).collect()
    own = [(i, windows(t)) for i, t in items]
    assert sorted(map(repr, ((d, *contaminated(t, own)) for d, t in docs))) == sorted(repr(tuple(r)) for r in got)


def test_op11_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert winnowing.decontaminate(docs.limit(0), items).collect() == []
    only = winnowing.digest(winnowing.decontaminate(docs, items.limit(0))).collect()
    assert [tuple(r) for r in only] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_winnowing_keeps_a_common_fingerprint_of_every_shared_window():
    rng = random.Random(3)
    for _ in range(300):
        shared = [rng.choice("abcd") for _ in range(winnowing.SPAN)]
        kept = []
        for _ in range(2):
            text = [rng.choice("abcd") for _ in range(rng.randrange(8))] + shared + [rng.choice("abcd") for _ in range(rng.randrange(8))]
            at = next(i for i in range(len(text)) if text[i : i + len(shared)] == shared)
            _, found = winnowing.fingerprints(" ".join(text).encode(), winnowing.WordHashes(), [], None)
            kept.append({(f["h"], f["pos"] - at) for f in found if 0 <= f["pos"] - at <= winnowing.SPAN - winnowing.GRAM})
        assert kept[0] & kept[1]


# ------------------------------------------------------------------------------ whitening


def whitening_expected(rows, k=4):
    kept = [(i, [math.floor(256.0 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in sorted({tuple(x) for _, x in kept})]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    x = np.array(fit, dtype=float)
    z = x - x.mean(axis=0)
    cov = z.T @ z / n
    e, axes = np.linalg.eigh(cov)
    order = np.argsort(-e)[: min(k, d)]
    return kept, n, sums, cov, e[order], axes[:, order]


def check_whitening(rows, got):
    kept, n, sums, cov, e, axes = whitening_expected(rows)
    assert len(got) == len(kept) * len(e)
    deviation = Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in kept)
    for c in range(len(e)):
        own = [r for r in got if r.component == c + 1]
        assert Counter((r.vec_id, r.deviation if r.deviation is not None else int(r.deviation_digits)) for r in own) == deviation
        assert all(r.n == n and abs(r.explained - e[c] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-9 for r in own)
        mean = np.array(sums) / n
        expected = sorted((str(i), float((np.array(x) - mean) @ axes[:, c] / math.sqrt(e[c]))) for i, x in kept)
        flipped = sorted((i, -v) for i, v in expected)
        found = sorted((str(r.vec_id), r.whitened) for r in own)
        near = lambda a: all(p[0] == q[0] and abs(p[1] - q[1]) < 1e-6 for p, q in zip(a, found, strict=True))  # noqa: E731, B023
        assert near(expected) or near(flipped)


def test_op12_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op12_bit_whitening(spark, SF).collect())


def test_op12_awkward_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, s) for s in (9.0, 5.0, 3.0, 1.5, 0.2)]) for i in range(300)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (900, None), (901, [None] * 5), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf")] * 5), (904, []), (905, [-0.0, 0.0, -0.0, 0.0, 0.0])]
    frame = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    check_whitening(rows, whitening.whiten(frame.repartition(7)).collect())


def test_op12_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    mixed = whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [1.5]), (3, [0.5, 1.0]), (4, [0.25, 3.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in mixed) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, -1e300]), (2, [1e300, 0.0]), (3, [-1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in huge if r.deviation is None} == {1, 2, 3} and all(int(r.deviation_digits) > 2**63 for r in huge)


def test_bit_planes_give_exact_cross_products():
    rng = np.random.default_rng(2)
    for low, high, rows in ((-3, 4, 1), (-200, 200, 777), (0, 1, 130), (-(2**62), 2**62, 40)):
        x = rng.integers(low, high, size=(rows, 6))
        x[:, 2] = 5
        sums, cross = whitening.cross_products(x)
        exact = x.astype(object)
        assert sums.tolist() == exact.sum(axis=0).tolist()
        assert all(cross[i, j] == int(exact[:, i] @ exact[:, j]) for i in range(6) for j in range(i, 6))
    for value in (0, -1, 2**127, -(2**126) + 12345):
        assert sum(v << whitening.LIMB * i for i, v in enumerate(whitening._limbs(value))) == value


# ------------------------------------------------------------------------------ ball trees


def ranked(docs, items, k=10):
    counted = [(d, Counter(words(t))) for d, t in docs]
    n_docs, length = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // length if length else 25
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(map(repr, out))


def test_op13_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ranked(docs, items) == sorted(repr(tuple(r)) for r in queries.op13_ball_tree(spark, SF).collect())


@pytest.mark.parametrize("block_terms", [5, ball_tree.BLOCK_TERMS])
def test_op13_awkward_rows(spark, block_terms):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "ä", "A1", "a1"]
    docs = [(i, random_text(rng, vocabulary, rng.randrange(1, 40))) for i in range(200)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, docs[5][1]), (300, None), (301, ""), (302, " .;"), (303, "w1 " * 4000)]
    items = [(i, random_text(rng, vocabulary, n)) for i, n in enumerate((1, 2, 8, 30))] + [(None, "w1 w2"), (2, "w3 w3 w4"), (9, "nowhere"), (10, None), (11, "")]
    got = ball_tree.rank(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3), with_clashes(spark.createDataFrame(items, "item_id long, text string")), block_terms=block_terms)
    assert ranked(docs, items) == sorted(repr(tuple(r)) for r in got.collect())


def test_op13_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_tree.rank(docs.limit(0), items).collect() == [] and ball_tree.rank(docs, items.limit(0)).collect() == []


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):  # documents of a few topics, some far longer than others
        index = np.sort(rng.choice(40, size=12, replace=False)) + 40 * (i % 5)
        rows.append((index, rng.integers(1, 1000 if i % 7 else 100_000, size=12)))
    size = np.array([len(r[0]) for r in rows])
    all_rows = ball_tree.Vectors(np.arange(len(rows)), np.r_[0, np.cumsum(size)], np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    root = ball_tree.tree(all_rows, np.add.reduceat(all_rows.value.astype(float) ** 2, all_rows.first[:-1]), 200, leaf=10)
    leaves = 0
    for q in range(40):
        terms = np.sort(rng.choice(40, size=6, replace=False)) + 40 * (q % 5)
        times, dense = rng.integers(1, 4, size=6), np.zeros(200, dtype=np.int64)
        best = ball_tree.Best(10)
        leaves += ball_tree.search(root, terms, times, dense, list(range(len(rows))), best)
        dense[terms] = times
        scores = all_rows.times(dense)
        assert best.rows == sorted((-int(s), False, i) for i, s in enumerate(scores) if s > 0)[:10]
    assert leaves < 40 * 60


def test_op3_repeated_rows_other_columns_and_long_vectors(spark):
    """Ties, repeated rows, clashing columns, several query blocks, lengths that let the bounds prune."""
    rng = random.Random(13)
    rows = [(i, [rng.gauss(0, 1) * (20 if i % 40 == 3 else 1) for _ in range(6)]) for i in range(600)]
    rows += [rows[50], rows[50], rows[3], (None, rows[4][1]), (700, rows[3][1]), (701, [1e300, -1.0, 0.0, 0.0, 0.0, 0.0]), (702, [0.5, 0.25]), (750, [1.0, 2.0]), (703, None), (704, [float("nan")] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("v", "dim", "length", "part", "score", "rank", "query_id"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = norm_topk.top_k(frame, F.col("vec_id") % 50 == 0, block_bytes=200)
    whole = [(i, [min(2.0**62, math.floor(256 * c)) for c in v]) for i, v in rows if i is not None and v and all(math.isfinite(c) for c in v)]
    want = []
    for q, qv in sorted({(i, tuple(v)) for i, v in whole if i % 50 == 0}):
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(qv, v, strict=True)))), i) for i, v in whole if i != q and len(v) == len(qv))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(want) == sorted(tuple(r) for r in got.collect())
