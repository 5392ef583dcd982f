"""Long rule lists, streams with state, rows and vault committed as one, counts without rewriting."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.functions import many_rules
from shroud.functions import rules as R
from shroud.plans import planted
from shroud.streaming import stream


def only(*on):
    return {k: k in on for k in R.DEFAULT_TOGGLES}


def test_literals_are_in_every_match():
    cases = {r"\bsk-[A-Za-z0-9]{20,}\b": "sk-", r"(?:ab|cd)xyz": "xyz", r"a?bc+d": "b", r"(foo)bar": "foobar", r"[a-z]+": "", r"(?i)abc": "", r"(?i:abc)def": "def", r"x(?:abc){2}y": "x", "a\\.b": "a.b", r"(?<=abc)d": "d", r"a|bcd": ""}
    for pattern, want in cases.items():
        got = many_rules.literal(pattern)
        assert got == want or (len(got) == len(want) and got in pattern), pattern


def test_folding_keeps_what_ignoring_case_matches():
    rng = random.Random(3)
    signs = "iIıİkKKsSſßẞµμéÉσςΣΐΐǅǆ"
    for _ in range(4000):
        a, b = ("".join(rng.choice(signs) for _ in range(3)) for _ in range(2))
        if re.fullmatch(re.escape(a), b, re.IGNORECASE):
            assert many_rules.folded(a) == many_rules.folded(b), (a, b)


def test_many_rules_find_what_each_rule_finds(spark):
    rng = random.Random(5)
    catalogue = [(f"r{i}", rng.choice([rf"\bk{i}-\d+", rf"z{i}[a-c]+", rf"(?P<n>q{i})-", rf"[x-z]{{2}}{i}"])) for i in range(300)] + [("bad", "(")]
    words = [f"w{i}" for i in range(200)] + ["ſtraße", "İx"]
    texts = ["".join(rng.choice([f"k{rng.randrange(320)}-7", f"z{rng.randrange(320)}ab", f"q{rng.randrange(320)}-", f"xy{rng.randrange(320)}", f"W{rng.randrange(220)}", "STRASSE", "STRAßE", "ix", " ", ", "]) for _ in range(30)) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cfg = RedactionConfig(enabled_categories=only("api_keys", "custom"), catalogue=catalogue, custom_keywords=words)
    got = sorted((r.id, r.start, r.end, r.entity_type, r.value) for r in api.candidates(df, "id", "text", cfg, normalize="none").collect())
    want = []
    for i, t in enumerate(texts):
        for name, rx in catalogue[:-1]:
            want += [(i, m.start(), m.end(), name.upper(), m[0]) for m in re.finditer(rx, t or "")]
        places = {}
        for w in words:
            for m in re.finditer(rf"\b{re.escape(w)}\b", t or "", re.IGNORECASE):
                places.setdefault((m.start(), m.end()), m[0])
        want += [(i, s, e, "CUSTOM", v) for (s, e), v in places.items()]
    assert got == sorted(want) and len(got) > 200


def test_two_thousand_rules_cost_about_what_twenty_do():
    rules = lambda n: tuple(zip(*((rf"\bk{i}-\d+\b", f"k{i}-") for i in range(n)), strict=True))
    text = "some words of a text k7-12 and more " * 400
    took = {}
    for n in (20, 2000):
        many_rules.hits(text, *rules(n), False)
        own, start = rules(n), time.perf_counter()
        for _ in range(20):
            found = many_rules.hits(text, *own, False)
        took[n] = time.perf_counter() - start
        assert len(found) == 400
    assert took[2000] < 4 * took[20]


def test_counts_are_those_of_the_rewritten_rows(spark):
    df = spark.createDataFrame([(1, "a@b.co c@d.co 10.0.0.1"), (2, "none"), (3, None)], "id int, text string")
    red = api.redact(df, "id", "text")
    for by, column in (("token_prefix", "counts_by_type"), ("category", "counts_by_category")):
        want = {(r.id, k, n) for r in red.collect() for k, n in (r[column] or {}).items()}
        assert {tuple(r) for r in api.counts(df, "id", "text", by=by).collect()} == want
    assert "array_join" not in api.counts(df, "id", "text")._jdf.queryExecution().optimizedPlan().toString()


def test_a_stream_drops_late_rows_and_goes_on_after_a_stop(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in planted.planted_stream_counts(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{sf}/orders.parquet')")
    assert got == sorted(con.sql(planted.ORACLES["planted_stream_counts"]).fetchall())
    late = con.sql(f"SELECT count(*) FROM orders WHERE {planted.K} % 8 = 3").fetchall()[0][0]
    assert len(got) == 12 and sum(n for _, _, n in got) > 0 and late > 0


def test_rows_and_vault_show_together_or_not_at_all(spark, tmp_path, monkeypatch):
    source, out, vault, checkpoint = (str(tmp_path / x) for x in ("in", "out", "vault", "checkpoint"))
    spark.createDataFrame([(1, "a@b.co"), (2, "c@d.co")], "id long, text string").coalesce(1).write.parquet(source)

    def go():
        sdf = spark.readStream.schema("id long, text string").parquet(source)
        stream.write_redacted_and_vault(stream.redact_stream(sdf, "id", "text", with_vault=True), ["id"], out, checkpoint, vault_path=vault).awaitTermination()

    real = api.vault
    monkeypatch.setattr(api, "vault", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        go()
    monkeypatch.setattr(api, "vault", real)
    assert spark.read.parquet(out).count() == 2 and stream.read_committed(spark, out).count() == 0
    go()
    assert stream.read_committed(spark, out).count() == 2
    assert {r.original_value for r in stream.read_committed(spark, out, vault).collect()} == {"a@b.co", "c@d.co"}
    assert spark.read.parquet(out).where(F.col("redacted_text") == "[EMAIL_1]").count() == 2
