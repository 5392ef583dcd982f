"""Texts in chunks against whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from shroud import api
from shroud.config import RedactionConfig
from shroud.functions import rules as R
from shroud.functions import seams
from shroud.operators import chunked

VALUES = ["bob@x.com", "987-65-4320", "AB1234567", "dob: 1987-11-30", "4242 4242 4242 4242", "Clara Nowak", "14 Harbour Lane", "172.16.8.44", "2001:db8:85a3:0:0:8a2e:370:7334", "0123456789abcdef0123456789abcdef", "zephyr,ine", "Ａｎｎａ Ｂｅｌｌ", "a", "1", " ", "\n", "ö", "́", "﻿", "x"]
MARKS = [",", "; ", "! ", "?", " ", "", "'", "[", "]", "=", "(", ")", "，"]


def texts(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(VALUES) + rng.choice(MARKS) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*out, None, "", "﻿﻿", "﻿,﻿ a@b.co", "one@two.org"]


def whole(df, **kw):
    red = api.redact(df, "id", "text", with_vault=True, **kw)
    v = api.vault(red, "id").drop("text_id")
    return {r.id: (r.original_text, r.redacted_text) for r in red.collect()}, sorted(map(tuple, v.collect()))


def in_chunks(df, size, **kw):
    red = chunked.redact_long(df, "id", "text", with_vault=True, chunk_chars=size, **kw)
    texts_ = {r.id: r.redacted_text for r in chunked.assembled(red, "id").collect()}
    originals = {r.id: r.original_text for r in chunked.assembled(red, "id", "original_text").collect()}
    return {i: (originals[i], t) for i, t in texts_.items()}, sorted(map(tuple, chunked.vault(red, "id").collect())), red


@pytest.mark.parametrize("size,keywords", [(1, []), (40, ["zephyr,ine"])])
def test_chunks_give_what_whole_texts_give(spark, size, keywords):
    df = spark.createDataFrame(list(enumerate(texts(60, size))), "id long, text string")
    cfg = RedactionConfig(custom_keywords=keywords, custom_regex=[r"h[ea]rbour \w+"])
    expected, got = whole(df, config=cfg), in_chunks(df, size, config=cfg)
    assert got[0] == expected[0] and got[1] == expected[1] and len(got[1]) > 200
    assert got[2].count() > 300
    first = [h for r in got[2].select("highlights").collect() for h in r.highlights or []]
    assert len(first) == len(got[1])


def test_repeated_keys_do_not_mix(spark):
    df = spark.createDataFrame([(1, "a@b.co, c@d.co, x"), (1, "a@b.co, c@d.co, x"), (1, "e@f.co, y")], "id long, text string")
    out = chunked.assembled(chunked.redact_long(df, "id", "text", chunk_chars=3), "id")
    assert sorted(r.redacted_text for r in out.collect()) == ["[EMAIL_1], [EMAIL_2], x", "[EMAIL_1], [EMAIL_2], x", "[EMAIL_1], y"]


def test_spans_of_a_model_over_seams(spark):
    """Spans inside chunks, over several, nested, chained, beyond the text, and beside rules' hits."""
    rng = random.Random(7)
    bodies = [t for t in texts(30, 99) if t and "﻿" not in t and "Ａ" not in t and "́" not in t and "，" not in t and len(t) > 20]
    rows = list(enumerate(bodies))
    spans = []
    for i, t in rows:
        for _ in range(rng.randrange(12)):
            s = rng.randrange(len(t))
            spans.append((i, s, s + rng.choice([1, 3, 8, 30, 90]), rng.choice(["PERSON", "gpe", "LOC", "ORG"])))
        spans += [(i, 0, len(t), "LOC")] if i % 9 == 0 else []
    df = spark.createDataFrame(rows, "id long, text string")
    ner = spark.createDataFrame(spans + spans[:5], "id long, start int, end int, label string")
    expected, got = whole(df, ner=ner), in_chunks(df, 5, ner=ner)
    assert got[0] == expected[0] and got[1] == expected[1]
    assert any(t[1] == "[LOCATION_1]" for t in expected[0].values())


def test_one_long_text_is_spread_over_tasks(spark):
    unit = "mail bob@x.com, call Clara Nowak; or 172.16.8.44! "
    df = spark.range(1).select("id", F.expr(f"repeat('{unit}', 20000)").alias("text"))
    pieces = chunked.chunks(df, "id", "text", chunk_chars=2000)
    assert pieces.select(F.spark_partition_id()).distinct().count() == 8
    red = chunked.redact_chunks(pieces, "id", with_vault=True)
    assert red.count() == 500
    last = red.orderBy(F.desc("block"), F.desc("idx")).first()
    assert [r.token for r in last.replacements][-1] == "[IPV4_20000]"
    assert last.replacements[-1].original_end == len(unit) * 20000 - 2
    out = chunked.assembled(red, "id").first().redacted_text
    assert out == "".join(f"mail [EMAIL_{i}], call [PERSON_{i}]; or [IPV4_{i}]! " for i in range(1, 20001))


def test_many_spans_of_one_key_are_split(spark):
    n = 200_000
    df = spark.range(1).select("id", F.expr(f"repeat('abcdef, ', {n})").alias("text"))
    ner = spark.range(n).select(F.lit(0).cast("long").alias("id"), (F.col("id") * 8).alias("start"), (F.col("id") * 8 + 6).alias("end"), F.lit("PERSON").alias("label"))
    red = chunked.redact_long(df, "id", "text", RedactionConfig(enabled_categories={k: k == "names" for k in R.DEFAULT_TOGGLES}), ner=ner, with_vault=True, chunk_chars=4000)
    rows = red.select(F.size("replacements").alias("k"), F.element_at("replacements", -1)["token"].alias("t")).collect()
    assert sum(r.k for r in rows) == n and max(r.k for r in rows) < 1000
    assert f"[PERSON_{n}]" in {r.t for r in rows}


def test_seams_are_characters_no_rule_can_touch():
    assert set(",;!?") <= set(seams.seams())
    assert "," not in seams.seams(RedactionConfig(custom_keywords=["a,b"]))
    assert set(seams.seams(RedactionConfig(custom_regex=[r"\w+;\w+", "[unclosed"]))) >= {",", "!"} and ";" not in seams.seams(RedactionConfig(custom_regex=[r"\w+;\w+"]))
    for loose in (r".+", r"[^a]", r"\S+", r"^x", r"x$", r"(?<=\W)x", r"(?s:.)"):
        assert seams.seams(RedactionConfig(custom_regex=[loose])) == ""
        with pytest.raises(ValueError):
            chunked.active_seams(RedactionConfig(custom_regex=[loose]))
    pattern = seams.seam_pattern(seams.seams())
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab ,;[") for _ in range(rng.randrange(40)))
        pieces = list(seams.cut(t, pattern, 5))
        assert "".join(pieces) == t and all(p[-1] in ",;[" and len(p) >= 5 for p in pieces[:-1])
