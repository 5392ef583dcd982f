"""The registered queries against brute force on a small table, and every operator on awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import bin_packing, fm_quality, host_rules, kn_toxicity, license_scan, line_templates, norm_topk, pareto_mix, queries, simhash_bytes, token_fst
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog again and again\nend", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again\nend", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again\nother words here", "b"),
    (3, None, None),
    (None, "nobody's text   under the MIT license!", "a"),
    (None, None, "b"),
    (4, "", ""),
    (5, " \t\n\x0b", "ü"),
    (6, "wort " * 3000, "a"),
    (7, "😀 梦  ▁x\x00 <s> <|endoftext|>", "b"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    frame = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in ("size", "copies", "score", "keys", "fp", "salt", "root", "line", "words", "host", "slot", "rank"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows):
    return sorted(rows, key=repr)


def test_op1(spark, docs):
    text = {d: t for d, t, _ in docs}
    for r in queries.op1_license_scan(spark, SF).collect():
        assert brute.licences(text[r.doc_id]) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op1_awkward(awkward, empty):
    rows = license_scan.digest(license_scan.scan(awkward)).collect()
    want = [(d, *brute.licences(t)) for d, t, _ in AWKWARD]
    assert by_text((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == by_text(want)
    assert license_scan.scan(empty).count() == 0


def test_fuzzy_matches_are_those_of_a_search_of_the_whole_text():
    import regex

    rng, scanner = random.Random(3), license_scan.Scanner(license_scan.NOTICES)
    for n in license_scan.NOTICES:
        for _ in range(60):
            words = list(n.phrase)
            for _ in range(rng.randint(0, n.edits + 1)):
                at = rng.randrange(len(words))
                words[at] = rng.choice(["", "x", words[at] + "q"])
            text = f" lorem ipsum {''.join(words)} dolor sit "
            found = [m for m in scanner.matches(text) if scanner.notices[m[0]] == n]
            whole = regex.search(f"(?b)(?: {n.phrase} ){{e<={n.edits}}}", text)
            if whole and all(w in whole.group().split() for w in n.core.split()) and whole.group()[0] == " " == whole.group()[-1]:
                assert found, (n, text)
            for _, s, e, edits in found:
                assert edits <= n.edits and regex.fullmatch(f"(?:{n.phrase}){{e<={n.edits}}}", text[s:e])


def test_spans_point_into_the_given_text(spark):
    frame = spark.createDataFrame([(1, "Über uns: Released under the M-I-T Licence? no.\nReleased, under the MIT\tLicense; ok")], "doc_id long, text string")
    row = license_scan.scan(frame).first()
    assert {m.label for m in row.matches} == {"mit"}
    assert "Released, under the MIT\tLicense" in {AW[m.start_char : m.end_char] for m in row.matches for AW in ["Über uns: Released under the M-I-T Licence? no.\nReleased, under the MIT\tLicense; ok"]}


def test_op2(spark, docs):
    rows = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in queries.op2_line_templates(spark, SF).collect()]
    assert sorted(rows) == sorted(brute.line_templates([(d, t) for d, t, _ in docs]))
    assert sum(r[2] for r in rows) > 0


def test_op2_awkward_and_variable_fields(awkward, empty, spark):
    found = line_templates.drop_recurring(awkward)
    assert found.columns == [*awkward.columns, "line_dedup"]
    want = brute.line_templates([(d, t) for d, t, _ in AWKWARD])
    assert by_text((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.text) for r in found.collect()) == by_text(want)
    assert line_templates.drop_recurring(empty).count() == 0
    log = "user {} logged in from host {} at the main office gate today"
    frame = spark.createDataFrame([(1, log.format("ann", "n1")), (2, log.format("ann", "n77")), (3, log.format("bob", "n5").replace("gate", "door")), (4, "nothing of the kind stands in this other line at all")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_templates.drop_recurring(frame).collect()}
    assert kept[2] == "" and kept[1] and kept[4]


def test_op3(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op3_norm_topk(spark, SF).collect())
    assert got == brute.top_k([(r.vec_id, r.embedding) for r in rows])


def test_op3_ties_nulls_and_dimensions(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(0, same), *((i, same) for i in range(1, 9)), (50, [1.0, 0.0, 0.0]), (60, None), (61, [1.0, None, 0.0]), (62, [float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0]), (64, []), (65, [1.0, 2.0]), (100, [3.0, 1.0]), (None, same), (66, [1e30, -1e30, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in norm_topk.top_k(frame.where("vec_id is null or vec_id <> 66"), F.col("vec_id") % 50 == 0).collect())
    assert got == brute.top_k([r for r in rows if r[0] != 66])
    assert [r[2] for r in got if r[0] == 0 and r[1] <= 5][1:] == [1, 2, 3, 4]
    assert norm_topk.top_k(frame, F.col("vec_id") % 50 == 0).count() > 0
    assert norm_topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def check_mix(rows, given):
    sizes, per = {}, {}
    for d, t, s in given:
        sizes[d, s] = len(brute.WORD.findall(t or ""))
        per[s] = per.get(s, 0) + sizes[d, s]
    want = brute.targets(per)
    taken = dict.fromkeys(per, 0)
    for r in rows:
        assert r.source_size == per[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return want, taken


def test_op4(spark, docs):
    found = pareto_mix.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = found.collect()
    want, taken = check_mix(rows, docs)
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - want[s]) <= max(r.size for r in rows if r.source == s) for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, found.collect()))


def test_op4_awkward(awkward, empty):
    rows = pareto_mix.mix(awkward).collect()
    assert len(rows) == len(AWKWARD)
    check_mix(rows, AWKWARD)
    assert pareto_mix.mix(empty).count() == 0


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name, label", [("op5_fm_quality", "quality"), ("op6_kn_toxicity", "toxic")])
def test_classifiers_hold_on_what_they_did_not_see(spark, name, label):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(found["score"].to_numpy(), found[label].to_numpy()) > 0.95
    assert (found["predicted"] == found[label]).mean() > 0.93


def test_classifiers_awkward(awkward, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (6, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for marks in (labels, none):
        model = fm_quality.train(awkward, marks, F.lit(True))
        rows = fm_quality.quality(awkward, model).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert fm_quality.quality(empty, model).count() == 0
        model = kn_toxicity.train(awkward, marks, F.lit(True), F.lit(True))
        rows = kn_toxicity.toxicity(awkward, model).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert kn_toxicity.toxicity(empty, model).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=fm_quality.SIZE).astype(np.float32), rng.normal(size=(fm_quality.SIZE, 4)).astype(np.float32)
    index, value = np.array([3, 17, 99, 1000]), rng.normal(size=4).astype(np.float32)
    pairs = sum(float(v[index[i]] @ v[index[j]]) * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    assert np.isclose(fm_quality.Model(0.5, w, v).logits(index, value, np.array([0]))[0], 0.5 + w[index] @ value + pairs, atol=1e-4)


def test_kneser_ney_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    gram = np.unique(rng.integers(0, kn_toxicity.GRAMS, 5000))
    p = kn_toxicity.shared_backoff(gram).reshape(-1, 32)
    assert np.allclose(p.sum(axis=1), 1)


def test_op7(spark, docs):
    text = {d: t for d, t, _ in docs}
    for r in queries.op7_host_rules(spark, SF).collect():
        assert brute.rules(text[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.kept and r.base_failed)


def test_op7_awkward_and_a_bad_host(awkward, empty, spark):
    rows = host_rules.rules(awkward).collect()
    assert by_text((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == by_text((d, *brute.rules(t)) for d, t, _ in AWKWARD)
    assert host_rules.rules(empty).count() == 0
    good = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(i, good if i % 50 == 0 or i >= 400 else "short", "bad" if i < 400 else "good") for i in range(800)], SCHEMA)
    kept = {r.doc_id for r in host_rules.rules(frame).where("kept").collect()}
    assert kept == set(range(400, 800))


def test_op8(spark, docs):
    fp = {d: brute.fingerprint(t) for d, t, _ in docs}
    roots = brute.components([(d, f) for d, f in fp.items()])
    for r in queries.op8_simhash_bytes(spark, SF).collect():
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == roots[fp[r.doc_id]]


def test_op8_awkward(awkward, empty):
    fps = [(d, brute.fingerprint(t)) for d, t, _ in AWKWARD]
    roots = brute.components(fps)
    rows = simhash_bytes.near_duplicates(awkward).collect()
    assert by_text((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in rows) == by_text((d, f, roots[f]) for d, f in fps)
    kept = simhash_bytes.representatives(awkward).collect()
    assert len(kept) == len(set(roots[f] if roots[f] is not None else f for _, f in fps))
    assert simhash_bytes.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [2, 64])
def test_no_link_is_lost_in_crowded_postings(spark, limit):
    rng = random.Random(limit)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(12):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(f)
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash_bytes.components(simhash_bytes.near_links(nodes, 2, limit)).collect()}
    classes = lambda root: sorted(sorted(f for f in fps if root(f) == r) for r in {root(f) for f in fps})
    want = brute.components([(f, f & (2**64 - 1)) for f in fps])
    assert classes(lambda f: got.get(f, f)) == classes(lambda f: want[f & (2**64 - 1)])


def check_packing(rows, given, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = []
    for d, t, _ in given:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for piece in range(-(-len(ids) // 2048)):
            n = (len(ids) - 1) % 2048 + 1 if piece == 0 else 2048
            want.append((d, piece, at, n, brute.crc(ids[at : at + n])))
            at += n
    assert by_text((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == by_text(want)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_op9(spark, docs, awkward, empty):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = queries.op9_bin_packing(spark, SF).collect()
    check_packing(rows, docs, path)
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1
    check_packing(bin_packing.pack(awkward, path).collect(), AWKWARD, path)
    assert bin_packing.pack(empty, path).count() == 0
    with_ids = bin_packing.pack(awkward, path, with_ids=True).collect()
    assert all(brute.crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in with_ids)


def test_segments_give_the_tokenizers_ids():
    rng, encoder = random.Random(5), bin_packing.SegmentIds(queries.tokenizer("byte_bpe_50k.json"))
    parts = ["a", "the", " ", "  ", "\n", "'s", "é", "梦", "😀", "\t", "<|endoftext|>", "12", "!!", "\x1c", "\x85", "　", "​", "ing "]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_plans_hold_every_piece_and_never_overflow():
    rng = random.Random(9)
    for _ in range(60):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        seen = {}
        for n, pattern in bin_packing.plan(histogram, 64):
            assert n > 0 and sum(pattern) <= 64
            for length in pattern:
                seen[length] = seen.get(length, 0) + n
        assert seen == histogram


def test_op10(spark, docs, awkward, empty):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    count = lambda given: by_text((d, len((t or "").encode()), len(plain.encode(t or ""))) for d, t, _ in given)
    assert by_text((r.doc_id, r.n_bytes, r.n_tokens) for r in queries.op10_token_fst(spark, SF).collect()) == count(docs)
    assert by_text((r.doc_id, r.n_bytes, r.n_tokens) for r in token_fst.token_counts(awkward, path).collect()) == count(AWKWARD)
    assert token_fst.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 16])
def test_chunk_maps_compose_to_the_whole_count(chunk):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    machine, plain, rng = token_fst.load(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(chunk)
    parts = ["a", "b", " ", "  ", "\n", "the", "ing", "▁", "é", "ß", "梦", "😀", "\t", "<s>", "0", "!!", "aaaa", "\x00", "\r"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert machine.count_text(token_fst.marked(text), chunk) == len(plain.encode(text)), repr(text)
