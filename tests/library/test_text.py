"""Numbers, units, standards, citations and claims on hand-checked cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import claims, numbers, text


def one(spark, column, *values):
    names = "abc"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*(F.col(n) for n in names)).alias("r")).first().r


@pytest.mark.parametrize(
    "raw,found",
    [("16.5", ["16.5"]), ("16,5", ["16.5"]), ("１６．５", ["16.5"]), ("-40 and +40", ["-40", "+40"]), ("10-20", ["10", "20"]), ("10–20", ["10", "20"]), ("1,000; 1000", ["1000", "1000"]), ("1.50 007 -0.0", ["1.5", "7", "0"]), ("пункт-5", ["5"]), (None, [])],
)
def test_numbers(spark, raw, found):
    assert one(spark, numbers.numbers, raw) == found


def test_missing_numbers(spark):
    missing = lambda a, b: one(spark, numbers.missing_numbers, a, b)
    assert missing("60 and 1,000", "1000 только") == ["60"] and missing("5", "5 и 6") == [] and missing("2 2 3", "2") == ["2", "3"] and missing("-40", "40") == ["-40"]


def test_standards(spark):
    assert one(spark, numbers.standards, "ISO 9001 and ГОСТ Р 52108-2003.") == ["9001", "52108-2003"]
    assert one(spark, numbers.standards, "between 5 and пункту 7, место 8") == []
    assert one(spark, numbers.missing_standards, "ISO 9001", "стандарт качества 9001") == ["9001"]


@pytest.mark.parametrize("raw,unit", [("МПа", "MPa"), ("м³/ч", "m3/h"), ("°С", "degC"), ("furlong", None), ("mPa", None), ("", ""), ("N·m", "N*m"), ("mm^2", "mm2")])
def test_units(spark, raw, unit):
    assert one(spark, numbers.normalized_unit, raw) == unit


def test_every_unit_is_its_own_name(spark):
    df = spark.createDataFrame([(u,) for u in numbers.UNITS if u not in ("degC", "degF")], "u string")
    assert len(numbers.UNITS) == 49 and all(r.u == r.n for r in df.select("u", numbers.normalized_unit(F.col("u")).alias("n")).collect())


@pytest.mark.parametrize(
    "raw,comma,number",
    [("−００１６,５０００", "reject", "-16.5"), ("-0.50", "reject", "-0.5"), ("+000", "reject", "0"), ("0,125", "reject", "0.125"), ("1,234", "reject", None), ("1,234", "decimal", "1.234"), ("1,234", "thousands", "1234"), ("1e3", "reject", None), ("1,234,56", "reject", None), ("1,234,567", "reject", "1234567")],
)
def test_strict_numbers(spark, raw, comma, number):
    assert one(spark, lambda c: numbers.strict_number(c, comma), raw) == number


def test_citation_widths(spark):
    assert [one(spark, lambda c, d=d: numbers.citations(c, d), "[1] [22] [333] [4444]") for d in (2, 3, 4)] == [[1, 22], [1, 22, 333], [1, 22, 333, 4444]]


def test_languages(spark):
    assert [one(spark, text.claim_language, t) for t in ("abc", "абв x", "漢 абв")] == ["en", "ru", "zh"]
    assert [one(spark, text.document_language, t) for t in ("abcd", "абв abc", "漢字字 abcdefgh", "")] == ["en", "ru", "zh", "en"]


def test_claim_spans(spark):
    answer = "# Итог\nPressure is 16 MPa [1][2]. Давление 20 бар [2]! 压力很高[3]。 Sources\n1. And:  \n"
    df = spark.createDataFrame([(1, answer), (2, None), (3, " \n ")], "id long, answer string")
    rows = claims.claim_spans(df, "id", "answer").orderBy("n").collect()
    assert all(answer[r.start : r.stop] == r.raw for r in rows) and {r.id for r in rows} == {1}
    assert [(r.claim, r.cited, r.language, r.non_factual) for r in rows][1:4] == [("Pressure is 16 MPa", [1, 2], "en", False), ("Давление 20 бар", [2], "ru", False), ("压力很高", [3], "zh", False)]
    assert rows[0].non_factual and {r.claim for r in rows if r.non_factual} == {"# Итог".replace("# ", ""), "Sources", "And:"}
