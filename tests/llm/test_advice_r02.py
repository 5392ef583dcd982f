
from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import bin_packing, fm_quality, host_rules, kn_toxicity, line_templates, pareto_mix, queries, simhash_bytes
from tests.llm import brute
from tests.llm.test_contracts import SCHEMA


def test_short_lines_recur_where_the_floor_admits_them(spark):
    texts = ["All rights reserved.\nLes.\n\nfirst words of one", "Les.\n\nAll rights reserved.\nother", "Page 3 of it\nLes", "Page 17 of it\n \nend 5", "end 6"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_templates.drop_recurring(frame, min_tokens=1).collect()}
    # 'end 5' and 'end 6': half of the tokens are fields, so the digit is masked and the later one goes
    assert kept == {0: texts[0], 1: "\nother", 2: texts[2], 3: " \nend 5", 4: ""}
    long = "one two three four five six seven eight nine"
    mixed = spark.createDataFrame([(1, f"{long}\nshort one"), (2, f"short one\n{long.replace('nine', 'ten')}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_templates.drop_recurring(mixed, min_tokens=1).collect()}[2] == ""


def test_a_small_bad_host_is_refused(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i == 0 else "short", "small") for i in range(16)] + [(i, good, "large") for i in range(100, 500)] + [(900, "short", "one"), (901, good, "two")]
    found = {r.doc_id: r.kept for r in host_rules.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not found[0] and not found[900] and found[901] and all(found[i] for i in range(100, 500))


def test_word_models_tell_expressions_that_the_signs_fold_together(spark):
    # the words differ in digits only, or in Cyrillic letters of one byte class: signs cannot tell them apart
    frame = spark.createDataFrame([(i, ("id10t said ещ the calm red door is here" if i % 2 else "id99t said ещ the calm red door is here"), "a") for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = kn_toxicity.train(frame, labels, F.col("doc_id") < 20, (F.col("doc_id") >= 20) & (F.col("doc_id") < 30))
    assert all(r.predicted == r.doc_id % 2 for r in kn_toxicity.toxicity(frame, model).collect())
    expressions = spark.createDataFrame([("go to the hell now", 1), ("the hell go to now", 0)], "text string, toxic int")
    pairs = kn_toxicity.pair_counts(expressions)
    # five words and the end of two texts: each place is counted once
    assert pairs.agg(F.sum(F.col("n_toxic") + F.col("n_plain"))).first()[0] == 12
    twice = frame.limit(1).unionByName(frame.limit(1))
    rounded = lambda rows: {tuple(round(x, 9) for x in r) for r in kn_toxicity.scored(rows, model, []).collect()}
    assert rounded(twice) == rounded(frame.limit(1))


@pytest.mark.parametrize("bucket_rows", [50, kn_toxicity.BUCKET_ROWS])
def test_frequent_and_rare_weights_give_the_same_features(spark, monkeypatch, bucket_rows):
    words = "a b c d e f g h i j".split()
    frame = spark.createDataFrame([(i, " ".join(words[(i * k) % 10] for k in range(1, 9)) + (" bad thing" if i % 2 else " good thing"), "a") for i in range(60)] + [(60, None, "a"), (61, "", "a")], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(kn_toxicity, "BUCKET_ROWS", bucket_rows)
    found = []
    for frequent in (1, 20, 1 << 16):  # no weight is frequent, some, all of them
        monkeypatch.setattr(kn_toxicity, "FREQUENT", frequent)
        model = kn_toxicity.train(frame, labels, F.col("doc_id") < 40, F.col("doc_id") >= 40)
        found.append((len(model.frequent.gram), {tuple(round(x, 9) for x in r) for r in kn_toxicity.scored(frame, model, []).collect()}))
    assert found[0][0] == 0 < found[1][0] < found[2][0]
    assert found[0][1] == found[1][1] == found[2][1]


def test_repeated_rows_and_labels_do_not_fill_the_fit(spark, monkeypatch):
    rows = [(i, f"text number {i} of {i % 2}", "a") for i in range(12)] + [(0, "text number 0 of 0", "a")] * 40 + [(1, f"other text {i}", "a") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(2, 0)] * 30, "doc_id long, mark int")
    seen = []
    fit, logistic = fm_quality.fit, kn_toxicity._logistic
    monkeypatch.setattr(fm_quality, "fit", lambda index, value, y, *a: seen.append(len(y)) or fit(index, value, y, *a))
    monkeypatch.setattr(kn_toxicity, "_logistic", lambda x, y: seen.append(len(y)) or logistic(x, y))
    fm_quality.train(frame, labels, F.lit(True), label_col="mark", fit_rows=24)
    kn_toxicity.train(frame, labels, F.lit(True), F.lit(True), label_col="mark", fit_rows=24)
    assert len(seen) == 2 and all(2 <= n <= 24 for n in seen)


@pytest.mark.parametrize("bits", [0, 1])
def test_no_link_is_lost_in_crowded_postings_below_two_bits(spark, bits):
    v = 2**50 + 1
    fps = [v, v ^ 2**40, v ^ 1, v ^ 2**40 ^ 2**50]  # the stars of v and v ^ 2**40 start at the other two
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash_bytes.components(simhash_bytes.near_links(nodes, bits, 1)).collect()}
    want = brute.components([(f, f) for f in fps], bits)
    same = lambda root: sorted(sorted(f for f in fps if root(f) == r) for r in {root(f) for f in fps})
    assert same(lambda f: got.get(f, f)) == same(lambda f: want[f])


def test_words_are_those_of_the_one_pattern():
    rng = np.random.default_rng(3)
    signs = list("ab Z_9.,!\n\t\r\x0b\x1c\x1f\x85\xa0\u0301\u2003 é日ж½²  ")
    texts = ["".join(rng.choice(signs, size=int(n))) for n in rng.integers(0, 40, size=3000)] + ["", " ", "é", "a" * 5000 + "é", "x é " * 2000]
    assert all(kn_toxicity.words_of(t) == kn_toxicity.WORDS.findall(t) for t in texts)


def test_word_weights_against_plain_kneser_ney(spark):
    """Counts, shared backoff, pruning and ratios of the word models, by dictionaries."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    texts = [(" ".join(words[min(29, int(x))] for x in rng.exponential(4 if toxic else 9, size=60)), toxic) for toxic in (0, 1, 0, 0, 1, 0) for _ in range(8)]
    got = {(r.n, r.gram): r.ratio for r in kn_toxicity.word_weights(spark.createDataFrame(texts, "text string, toxic int").repartition(5)).collect()}

    hashes = kn_toxicity.WordHashes()
    pairs = [Counter(), Counter()]
    for text, toxic in texts:
        h = kn_toxicity.word_hashes(text.encode(), hashes).tolist()
        pairs[toxic].update(zip(h[:-1], h[1:], strict=True))
    both = set(pairs[0]) | set(pairs[1])
    before = Counter(w for _, w in both)
    single = [Counter(), Counter()]
    for side in (0, 1):
        for (_, w), n in pairs[side].items():
            single[side][w] += n
    discount = lambda counts: (lambda one, two: one / (one + 2 * two) if one else 0.5)(sum(n == 1 for n in counts), sum(n == 2 for n in counts))
    d0, kinds, all_before = discount(before.values()), len(before), sum(before.values())
    below = {w: max(before[w] - d0, 0) / all_before + d0 * kinds / all_before / (kinds + 1) for w in before}
    total = [sum(c.values()) for c in single]

    def differs(plain, toxic):
        n, g = plain + toxic, 0.0
        for c, side in ((plain, 0), (toxic, 1)):
            g += c * np.log(c / (n * total[side] / sum(total))) if c else 0.0
        return 2 * g >= kn_toxicity.LEAST_G

    def probability(n, d, context, lower):
        t, k = sum(context), sum(c > 0 for c in context)
        return (max(n - d, 0) / t if t else 0) + (d * k / t if t else 1) * lower

    want = {}
    for w in before:
        if differs(single[0][w], single[1][w]):
            p = [probability(single[s][w], discount(single[s].values()), list(single[s].values()), below[w]) for s in (0, 1)]
            want[1, np.array([w], np.uint64).view(np.int64)[0]] = np.log(p[1] / p[0])
    for v, w in both:
        if (pairs[1][v, w] or pairs[0][v, w] >= kn_toxicity.LEAST_PLAIN) and differs(pairs[0][v, w], pairs[1][v, w]):
            p = [probability(pairs[s][v, w], discount(pairs[s].values()), [n for (a, _), n in pairs[s].items() if a == v], below[w]) for s in (0, 1)]
            want[2, kn_toxicity.pair_keys(np.array([v], np.uint64), np.array([w], np.uint64)).view(np.int64)[0]] = np.log(p[1] / p[0])
    assert {n for n, _ in want} == {1, 2} and set(want) == set(got)
    assert all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_a_host_of_few_documents_is_refused_in_the_oracle_too(spark, tmp_path):
    """Operator and SQL on a table with refused hosts."""
    import duckdb

    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i == 0 else "short", "small") for i in range(16)] + [(i, good, "large") for i in range(100, 500)] + [(900, "short", "one"), (901, good, "two"), (902, good, None), (903, "x", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = queries.op7_host_rules(spark, str(tmp_path))
    want = con.sql(queries.HOST_SQL)
    at = [want.columns.index(c) for c in found.columns]
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert not kept[0] and kept[100]


def test_equal_rows_and_null_ids_are_drawn_one_by_one(spark):
    """Three sources: distinct rows, equal rows, rows without an id; each comes within a document of its target."""
    text = "a b c d e f g h i j"
    rows = [(i, text, "a") for i in range(1000)] + [(5, text, "b")] * 1000 + [(None, text, "c")] * 1000
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    drawn = [pareto_mix.mix(f).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"), F.max("copies").alias("most"), F.countDistinct("occurrence").alias("k")).orderBy("source").collect() for f in (frame, frame.repartition(9))]
    for r in drawn[0]:
        assert r.n == 1000 and abs(r.taken - r.target) <= 10 and r.most <= 3
    assert [r.k for r in drawn[0]] == [1, 1000, 1000]
    assert [r.taken for r in drawn[0]] == [r.taken for r in drawn[1]]


def test_larger_documents_are_drawn_as_often_as_their_odds_say(spark):
    """Inclusion over many ids: proportional to the square root of the size, as mixed."""
    rows = [(i, " ".join("x" * (4 if i % 2 else 16)).replace("  ", " "), s) for s in "abc" for i in range(6000)]
    got = pareto_mix.mix(spark.createDataFrame(rows, SCHEMA)).where("source = 'c'").groupBy("size").agg(F.avg(F.col("copies").cast("double")).alias("p")).collect()
    p = {r["size"]: r.p for r in got}
    assert 0 < p[4] < 1 and abs(p[16] / p[4] - 2) < 0.25


def test_ids_are_the_same_when_nothing_is_remembered(monkeypatch):
    encoder = bin_packing.SegmentIds(queries.tokenizer("byte_bpe_50k.json"))
    texts = ["one two two three", "x" * 5000 + " y", "", "naïve  café\nЖук", "one two"] * 2
    monkeypatch.setattr(bin_packing, "REMEMBERED", 0)
    assert [encoder.encode(t) for t in texts] == [encoder.whole(t) for t in texts]
    assert len(encoder.known) <= 2  # only the last text's
