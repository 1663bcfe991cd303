"""Quantities and technical entities in text: numbers with their units, standards, formulas.

Column expressions; a text's matches are arrays, never rows of another language.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import STANDARDS_CYRILLIC, STANDARDS_LATIN, UNITS, let, multiset_difference, normalized_unit, strict_number

CITATION = r"\[[0-9]{1,3}\]"
# How numbers, formulas and units are written.
NUMBER_TEXT = r"[+\-−＋－]?\d+(?:[ \u00a0,，]\d{3})*(?:[.,，．]\d+)?"
FORMULAS = (
    r"\$\$(?=\S)(?:.|\n)*?(?<=\S)\$\$",
    r"(?<!\\)\$(?=\S)[^$\n]+?(?<=\S)\$",
    r"\\\((?=\S).*?(?<=\S)\\\)",
    r"\\\[(?=\S)(?:.|\n)*?(?<=\S)\\\]",
    r"(?<!\w)[A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9_]{0,9}\s*=\s*[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9_*/^()+.\-]{1,40}",
)
STANDARD = rf"(?<!\w)(?:(?i:{STANDARDS_CYRILLIC})|{STANDARDS_LATIN})\s?[-—–]?\s?\d[\d.\-—–/]*"
MORE_UNITS = [
    "兆帕", "千帕", "帕", "ksi", "巴", "mmHg", "мм рт. ст.", "мм рт ст", "deg C", "deg F", "degC", "degF", "°С", "摄氏度", "华氏度", "千瓦", "兆瓦", "瓦", "mV", "мВ", "千伏", "伏", "kA", "кА", "毫安", "千安", "安培", "MN", "МН", "MHz", "МГц",
    "mg", "мг", "lb", "lbs", "oz", "千克", "公斤", "毫克", "克", "吨", "мкм", "µm", "um", "in", "inch", "inches", "ft", "yd", "дюйм", "дюйма", "дюймов", "毫米", "厘米", "千米", "微米", "米", "gal", "bbl", "boe", "scf", "mcf", "毫升", "升",
    "ms", "мс", "days", "сут", "毫秒", "秒", "分钟", "小时", "天", "％", "‰", "ppm", "ppb", "m/h", "м/ч", "mm/s", "мм/с", "cm/s", "см/с", "km/h", "км/ч",
]
KINDS = ("formula", "standard", "measurement", "number")
_EDGE = "A-Za-zА-Яа-я0-9０-９_"


def unit_pattern() -> str:
    """Any spelling of a known unit, longest first; squares and cubes also as ² and ³, products also with a dot, degrees also with a blank."""
    spelled = {v for of in UNITS.values() for v in of.split()} | set(MORE_UNITS)
    out = []
    for unit in sorted(spelled, key=lambda u: (-len(u), u)):
        p = re.escape(unit).replace("\\*", "[*·⋅ ]?").replace("2", "[²2]").replace("3", "[³3]").replace("°", "°\\s?").replace("\\ ", "\\s*")
        out.append(p)
    return "|".join(out)


def patterns() -> tuple[list[re.Pattern], ...]:
    """Patterns by kind, in the order of KINDS."""
    measured = rf"(?<![{_EDGE}]){NUMBER_TEXT}(?:\s*[-–—…]\s*{NUMBER_TEXT})?\s*(?i:{unit_pattern()})(?![{_EDGE}])"
    return [re.compile(p) for p in FORMULAS], [re.compile(STANDARD)], [re.compile(measured)], [re.compile(NUMBER_TEXT)]


def spans(text: str | None, of: tuple[list[re.Pattern], ...]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's entities in their order.

    All matches of all patterns are candidates; kinds go in the order of KINDS, in a kind the first start and then the longest. One that overlaps
    an entity taken before is left out. Taken ones are disjoint, so that only the neighbours of a candidate's place can overlap it.
    """
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for kind, group in zip(KINDS, of):
        for start, minus in sorted({(m.start(), -m.end()) for p in group for m in p.finditer(text or "")}):
            at = bisect.bisect_left(starts, -minus)  # entities that start before the candidate's end
            if not at or taken[at - 1][1] <= start:
                starts.insert(at, start)
                taken.insert(at, (start, -minus, kind))
    return taken


#: A signed number, in groups of three or with its decimals, and what directly follows it, taken for its unit.
MENTION = r"(?U)(?<![\w.,])([+\-−]?(?:\d{1,3}(?:[ \u00a0]\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)*))(?:\s?([%°℃µ\p{L}][\p{L}\d²³^/·*]*))?"


def mentions(text: Column, comma: str = "decimal") -> Column:
    """(value, unit) of every number, citations aside; the unit is empty where there is none, null where it is unknown."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), CITATION, "")
    values, units = (F.regexp_extract_all(plain, F.lit(MENTION), F.lit(i)) for i in (1, 2))
    return F.zip_with(values, units, lambda v, u: F.struct(strict_number(v, comma).alias("value"), normalized_unit(u).alias("unit")))


def support(answer: Column, evidence: Column) -> Column:
    """Counts of an answer's mentions that its evidence lacks, by pair and by value; a number without a known unit is a pair of its own."""
    pair = "cast(array() as array<struct<value:string,unit:string>>)"

    def counts(s: Column) -> Column:
        held = lambda xs, m: F.exists(xs, lambda x: x == m)
        loose = F.filter(s["have"], lambda m: m["unit"].isNull() | ~F.coalesce(held(s["of"], m), F.lit(False)))
        unknown = F.filter(s["have"], lambda m: ~F.coalesce(held(F.transform(s["of"], lambda x: x["value"]), m["value"]), F.lit(False)))
        n = F.size(s["have"])
        return F.struct(
            n.alias("mentioned"), F.size(loose).alias("unsupported_pairs"), F.size(unknown).alias("unsupported_values"), F.size(F.filter(s["have"], lambda m: m["unit"].isNull())).alias("invalid_units"),
            F.when(n > 0, F.size(loose) / n).otherwise(0.0).alias("unsupported_rate"),
        )

    return let(F.struct(F.coalesce(mentions(answer), F.expr(pair)).alias("have"), F.coalesce(mentions(evidence), F.expr(pair)).alias("of")), counts)


ENTITY = "array<struct<kind: string, value: string, start: int>>"


def entities(text: Column) -> Column:
    """(kind, value, start) of a text's formulas, standards, measurements and other numbers, by ``spans``; places count characters from 0.

    No built-in function gives the places of matches, nor one pattern the order of the kinds: a batch at a time in Python.
    """

    @F.pandas_udf(ENTITY)
    def found(batch: pd.Series) -> pd.Series:
        of = patterns()
        return pd.Series([[{"kind": k, "value": t[a:b], "start": a} for a, b, k in spans(t, of)] for t in batch.fillna("")])

    return found(text)


def token(i: Column) -> Column:
    return F.concat(F.lit("⟪E_"), i.cast("string"), F.lit("⟫"))


def protected(text: Column) -> Column:
    """The text with a token in place of every entity, numbered from 0."""

    def put(s: Column) -> Column:
        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("i"))

        def step(acc: Column, e: Column) -> Column:
            before = F.substring(s["text"], acc["at"] + 1, e["start"] - acc["at"])
            return F.struct(F.concat(acc["out"], before, token(acc["i"])).alias("out"), (e["start"] + F.char_length(e["value"])).alias("at"), (acc["i"] + 1).alias("i"))

        return F.aggregate(s["found"], begin, step, lambda acc: F.concat(acc["out"], F.substring(s["text"], acc["at"] + 1, F.char_length(s["text"]))))

    return let(F.struct(F.coalesce(text, F.lit("")).alias("text"), entities(text).alias("found")), put)


def restored(text: Column, values: Column) -> Column:
    """``text`` with every token replaced by the value of its number."""
    return F.aggregate(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), text, lambda t, e: F.replace(t, token(e["i"]), e["v"]))


def token_problems(text: Column, values: Column) -> dict[str, Column]:
    """Tokens that a translation lost, doubled or made up."""
    seen = F.regexp_extract_all(text, F.lit("⟪E_[0-9]+⟫"), F.lit(0))
    wanted = F.transform(values, lambda _, i: token(i))
    times = lambda t: F.size(F.filter(seen, lambda s: s == t))
    return {"missing": F.filter(wanted, lambda t: times(t) == 0), "duplicated": F.filter(wanted, lambda t: times(t) > 1), "unknown": F.array_sort(F.array_except(seen, wanted))}


def unconfirmed(source: Column, translated: Column) -> Column:
    """Entities of the source, as kind and value, that its translation lacks, with their multiplicity."""
    named = lambda t: F.transform(entities(t), lambda e: F.concat_ws(":", e["kind"], e["value"]))
    return multiset_difference(named(source), named(translated))
