"""Files read in byte ranges against whole files."""

import random

from pyspark.sql import functions as F

from shroud import api
from shroud.operators import chunked
from shroud.sources import files, ranges


def whole(spark, path, **kw):
    read = files.read_text_files(spark, path, **kw)
    red = api.redact(read, "path", "text", with_vault=True)
    texts = {r.path: r.redacted_text for r in red.collect()}
    errors = {r.path: r.error for r in read.select("path", "error").collect()}
    return {p.split("/")[-1]: (t, errors[p]) for p, t in texts.items()}, sorted(map(tuple, api.vault(red, "path").drop("text_id").collect()))


def in_ranges(spark, path, size, **kw):
    pieces = ranges.read_text_chunks(spark, path, chunk_chars=size, **kw)
    red = chunked.redact_chunks(pieces, ["path", "name"], with_vault=True)
    errors = {r["name"]: r.error for r in pieces.select("name", "error").collect()}
    texts = {r["name"]: (r.redacted_text, errors[r["name"]]) for r in chunked.assembled(red, ["path", "name"]).collect()}
    return texts, sorted(map(tuple, chunked.vault(red, ["path"]).collect())), pieces


def test_small_ranges_give_the_same_hits_as_whole_files(spark, tmp_path):
    rng = random.Random(2)
    values = ["bob@x.com", "Clara\nNowak", "Clara Nowak", "14\nHarbour Lane", "4242 4242\n4242 4242", "10.1.2.3", "é漢😀", "x", "word", "\r\n", "\n", "\r", ", ", "; ", "!", " ", "Ａnna Ｂell"]
    for i in range(6):
        body = "".join(rng.choice(values) for _ in range(rng.choice([3, 60, 400])))
        (tmp_path / f"f{i}.txt").write_bytes((body + rng.choice(["", "\n", "\r", "\r\n", "\n\n"])).encode())
    (tmp_path / "empty.md").write_bytes(b"")
    (tmp_path / "line.md").write_bytes(b"\n")
    (tmp_path / "mark.txt").write_bytes("﻿a@b.co\nx,y".encode())
    (tmp_path / "noseam.log").write_bytes(b"Clara Nowak\n" * 60)
    (tmp_path / "bad.txt").write_bytes(b"ok line,\n" * 20 + b"\xff\xfe broken\n" + b"more,\n" * 20)
    (tmp_path / "prog.exe").write_bytes(b"x")
    expected = whole(spark, str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for limit in (61,):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(limit))
            texts, vault, pieces = in_ranges(spark, str(tmp_path), 30)
            assert texts == expected[0] and vault == expected[1]
            assert pieces.where("name like 'f%'").select("block").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(vault) > 100 and texts["bad.txt"] == (None, "invalid utf-8") and texts["prog.exe"] == (None, "unsupported file type") and "empty.md" not in texts


def test_any_suffix_on_request(spark, tmp_path):
    (tmp_path / "a.exe").write_text("mail a@b.co, now")
    texts, vault, _ = in_ranges(spark, str(tmp_path), 1000, extensions=None)
    assert texts == {"a.exe": ("mail [EMAIL_1], now", None)} and len(vault) == 1
