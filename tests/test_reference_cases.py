"""One labelled sentence per kind of rule, through detection, recall and round trip."""

import json

from shroud.config import RedactionConfig
from shroud.operators import evaluate

MIXED = (
    "Invoice for Clara Nowak (clara.nowak@mail.test, tel. 030 5559 1274), paid with 5555 5555 5555 4444 "
    "from host 172.16.8.44; deploy key ghp_0123456789abcdefghijABCDEFGHIJ."
)

# name, text, expected tokens (alternatives by |), keywords
CORPUS = [
    ("mail_phone", "Write to desk@firm.test or ring 0171 555 80 12 before noon.", ["EMAIL", "PHONE"], []),
    ("long_key", "The runner reads sk-Zz0Yy1Xx2Ww3Vv4Uu5Tt6Ss7Rr8 at start.", ["OPENAI_KEY|GENERIC_SECRET"], []),
    ("card_ssn", "Paid by 4111 1111 1111 1111, holder 987-65-4320.", ["CREDIT_CARD", "SSN"], []),
    ("host_street", "Rack 172.16.8.44 stands at 14 Harbour Lane.", ["IPV4", "ADDRESS"], []),
    ("birthday", "Born on 30/11/1987, says the form.", ["DOB"], []),
    ("code_word", "The word zephyrine appears once.", ["CUSTOM"], ["Zephyrine"]),
]


def test_one_sentence_with_many_kinds(redact_one):
    prefixes = {t.split("_")[0] for t in redact_one([MIXED])[0].redacted_text.split("[")[1:]}
    assert {"EMAIL", "PHONE", "PERSON", "CREDIT", "IPV4", "GITHUB"} <= prefixes


def test_restore_roundtrip(spark, redact_one):
    from shroud import api

    df = spark.createDataFrame([(1, "Ask Nora Lind via nora@firm.test")], "id long, text string")
    red = api.redact(df, "id", "text", with_vault=True)
    assert api.restore_own(red, "id").collect()[0].restored_text == "Ask Nora Lind via nora@firm.test"


def test_a_switched_off_category_stays_in_the_text(redact_one):
    off = RedactionConfig(enabled_categories={"emails": False})
    for row in redact_one(["desk@firm.test, 0171 555 80 12", "0171 555 80 12 (desk@firm.test)"], off).values():
        assert "desk@firm.test" in row.redacted_text and "[PHONE_1]" in row.redacted_text


def test_a_built_in_rule_wins_over_a_custom_one_on_the_same_span(redact_one):
    row = redact_one(["desk@firm.test"], RedactionConfig(custom_regex=[r"desk@firm\.test"]))[0]
    assert row.redacted_text == "[EMAIL_1]"


def test_corpus_samples_and_roundtrip(spark):
    """Per-row keywords: one scan per distinct keyword list, then the recall job."""
    from shroud import api

    expected = spark.createDataFrame([(n, e) for n, _, e, _ in CORPUS], "name string, expected_any array<string>")
    parts = []
    for kws in {tuple(k) for *_, k in CORPUS}:
        rows = [(n, t) for n, t, _, k in CORPUS if tuple(k) == kws]
        df = spark.createDataFrame(rows, "name string, text string")
        parts.append(api.redact(df, "name", "text", RedactionConfig(custom_keywords=list(kws)), with_vault=True))
    red = parts[0]
    for p in parts[1:]:
        red = red.unionByName(p)
    assert evaluate.expected_misses(expected, red, "name").count() == 0
    assert evaluate.roundtrip_failures(red, "name").count() == 0
    rep = {r.item: r.recall for r in evaluate.recall_report(expected, red, "name").collect()}
    assert all(v == 1.0 for v in rep.values()) and len(rep) == 9


def test_corpus_json_shape(spark, tmp_path):
    """The labelled corpus file format reads with the documented schema."""
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps([{"name": n, "text": t, "expected_any": e, "custom_keywords": k} for n, t, e, k in CORPUS]))
    df = spark.read.schema(
        "name string, text string, expected_any array<string>, custom_keywords array<string>, custom_regex array<string>"
    ).option("multiLine", "true").json(str(path))
    assert df.count() == 6
    assert df.where("name = 'code_word'").first().custom_keywords == ["Zephyrine"]
