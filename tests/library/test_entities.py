"""Entities and quantities over real strings, and against a plain greedy choice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import quantities
from sparkloom.plans import guards


def found(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quantities.entities(F.col("t")).alias("e")).orderBy("i").collect()
    return [[(e.kind, e.value) for e in r.e] for r in rows]


CASES = {
    "давление 10 МПа": [("measurement", "10 МПа")],
    "at 50 psi and 5 л/мин": [("measurement", "50 psi"), ("measurement", "5 л/мин")],
    "5-10 mm wide": [("measurement", "5-10 mm")],
    "see $$a=b$$ there": [("formula", "$$a=b$$")],
    r"\(x+1\) and \[y\]": [("formula", r"\(x+1\)"), ("formula", r"\[y\]")],
    "E=mc^2 by 1905": [("formula", "E=mc^2"), ("number", "1905")],
    "ГОСТ Р 12.1-2003, ISO 9001": [("standard", "ГОСТ Р 12.1-2003"), ("standard", "ISO 9001")],
    "between 3 and 1 200,5 kg": [("number", "3"), ("measurement", "1 200,5 kg")],
    "API 5L at 20 °C, 100%": [("standard", "API 5"), ("measurement", "20 °C"), ("measurement", "100%")],
    "压力 5 兆帕": [("measurement", "5 兆帕")],
    "100 meters": [("number", "100")],
    "": [],
}


def test_cases(spark):
    for text, got in zip(CASES, found(spark, *CASES)):
        assert got == CASES[text], text
    assert found(spark, None) == [[]]


def greedy(text):
    """All candidates against all taken ones."""
    candidates = [(rank, m.start(), -m.end()) for rank, group in enumerate(quantities.patterns()) for p in group for m in p.finditer(text)]
    taken = []
    for rank, start, minus in sorted(set(candidates)):
        if not any(start < e and -minus > s for s, e, _ in taken):
            taken.append((start, -minus, quantities.KINDS[rank]))
    return sorted(taken)


def test_spans_equal_a_plain_greedy_choice():
    rng = random.Random(6)
    pieces = ["10", "МПа", " ", "-", "5", "mm", "$", "$$", "a=b1", "ISO ", "9001", ",", ".", "ГОСТ", "x", "\n", "%", "=", "1 200", r"\(", r"\)", "kg/m3"]
    of = quantities.patterns()
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert quantities.spans(text, of) == greedy(text)


def test_protection_is_reversible(spark):
    texts = [*CASES, "no entities", "1 2 3 4 5 6 7 8 9 10 11 12"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    values = F.transform(quantities.entities(F.col("t")), lambda e: e["value"])
    got = rows.select("t", quantities.protected(F.col("t")).alias("p"), quantities.restored(quantities.protected(F.col("t")), values).alias("r")).collect()
    assert all(r.r == r.t for r in got) and all(not any(c.isdigit() for c in r.p.replace("⟪E_", "\0").split("\0")[0]) for r in got)


@pytest.mark.parametrize(
    "text, want",
    [("mass 1 200 kg", [("1200", "kg")]), ("1 200 300,5 kg and 7 bar [3]", [("1200300.5", "kg"), ("7", "bar")]), ("12 3456 m", [("12", ""), ("3456", "m")]), ("−5 °C", [("-5", "degC")]), ("3 widgets", [("3", None)]), (None, [])],
)
def test_mentions(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(quantities.mentions(F.col("t")).alias("m")).first().m
    assert [(m.value, m.unit) for m in got] == want


def test_query_counts_all_texts(spark):
    sf = "/root/testdata/sf0.001"
    of, want = quantities.patterns(), {}
    for r in guards.table(spark, sf, "documents").collect():
        for s, e, kind in quantities.spans(r.text, of):
            n, values = want.setdefault((r.source, kind), [0, set()])
            want[r.source, kind] = [n + 1, values | {r.text[s:e]}]
    assert {(r.source, r.kind): (r.n, r["values"]) for r in guards.scn1_texts(spark, sf).collect()} == {k: (n, len(v)) for k, (n, v) in want.items()}
