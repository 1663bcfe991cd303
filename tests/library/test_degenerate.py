"""Texts that are mostly one character."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from sparkloom.operators import pages


def plain(text):
    t = " ".join(text.split())
    body, words = t.replace(" ", ""), t.lower().split(" ")
    top = max((body.count(c) for c in set(body)), default=0)
    return len(t) >= 40 and (top > 0.8 * len(body) or len(t) > 8000 or (len(words) >= 60 and len(set(words)) < 0.35 * len(words)))


def test_one_character_of_many(spark):
    texts = ["", "a" * 40, "a b " * 30, "aaaa b " * 20, "aaaab" * 9, "aaaab" * 9 + "a", "b" + "aaaaab" * 9, "\U0001f600" * 50, "\U0001f600 " * 36 + "abcdefghi" * 2, " ".join("." * 21), ". " * 17 + "a b c d", "same words " * 40, "x" * 8001]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", pages.degenerate(F.col("t")).alias("d")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_many_different_characters_take_no_longer(spark):
    rows = [(i, "".join(chr(0x4E00 + (i + k) % 7_900) for k in range(7_900))) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, t string").select(pages.degenerate(F.col("t")).alias("d"))
    began = time.time()
    assert not any(r.d for r in df.collect()) and time.time() - began < 10
