"""Paragraphs of a page's text layer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import pages

CASES = [
    (None, []), ("", []), (" \r\n\t\n", []), ("IV\nfirst line\r\nsecond", ["first line second"]), ("12", []), ("1234567\nx", ["1234567 x"]),
    ("Intro\nmore\n1. One\ngoes on\n2.1 Two\n(b) sub\nField name: value\n(toolong) no\n3.no", ["Intro more", "1. One goes on", "2.1 Two", "(b) sub", "Field name: value (toolong) no 3.no"]),
    ("1. One\nx", ["1. One x"]),
    ("Contents\nA ..... 1\nB ……… 2\nC ... 33\n", ["Contents\nA  …  1\nB  …  2\nC  …  33"]),
    ("A .... 1\nB .... 2\nx", ["A .... 1 B .... 2 x"]),
    ("A .... 1\nB .... 2\nC .... 3\n" + "\n".join("abcdefgh"), ["A .... 1 B .... 2 C .... 3 a b c d e f g h"]),
]


def test_page_paragraphs(spark):
    df = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(CASES)], "i int, page string")
    got = {r.i: r.p for r in df.select("i", pages.page_paragraphs(F.col("page")).alias("p")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


@pytest.mark.parametrize("lines", [3, 20_000])
def test_long_paragraphs_are_cut(spark, lines):
    page = "\n".join(f"Sentence number {i} ends here." for i in range(lines))
    (r,) = spark.createDataFrame([(page,)], "page string").select(pages.page_paragraphs(F.col("page"), 200).alias("p")).collect()
    assert max(map(len, r.p)) <= 201 and " ".join(r.p) == page.replace("\n", " ")


def test_lines_keep_their_digits(spark):
    """A line's place is no set of characters to trim."""
    page = "0 zero 0\n \u00a01. one 1\u3000 \n2 two 2\n"
    (r,) = spark.createDataFrame([(page,)], "page string").select(pages.paragraphs(F.col("page"), r"^[0-9]+[.]").alias("p")).collect()
    assert r.p == ["0 zero 0", "1. one 1 2 two 2"]
