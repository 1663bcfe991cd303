"""Numbers, units, standards and citations in text, as column expressions.

Patterns use (?U), so that word characters and digits are those of any script, as Python's are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH, PLAIN = "０１２３４５６７８９，．−＋－", "0123456789,.-+-"
NUMBER = r"(?U)(?:(?<!\w)[+\-])?\d+(?:[  ,]\d{3})*(?:[.,]\d+)?"
#: Prefixes of standards; fixed values.
STANDARDS_CYRILLIC = "ГОСТ\\s?Р|ГОСТ|ОСТ|СНиП|СТО|СП|ТУ|РД|ВСН|НПБ|ПБ|ФНП|СанПиН|ИСО|МЭК|АПИ"
STANDARDS_LATIN = "ISO|IEC|API|ASTM|ASME|ANSI|DIN|EN|BS|NACE|NORSOK|UL|NFPA"
STANDARD = rf"(?U)(?<!\w)(?:(?i:{STANDARDS_CYRILLIC})|{STANDARDS_LATIN})\s?[-—–]?\s?(\d[\d.\-—–/]*)"
#: Spellings of every unit; fixed values. Superscripts, carets, middle dots and blanks are
#: levelled first, so one spelling of each is listed.
UNITS = {
    "%": "%", "degC": "°C °c °С °с ℃", "degF": "°F", "K": "K К", "Pa": "Pa Па", "kPa": "kPa кПа", "MPa": "MPa МПа", "GPa": "GPa ГПа", "bar": "bar Bar бар", "mbar": "mbar мбар", "psi": "psi",
    "mm": "mm мм", "cm": "cm см", "m": "m м", "km": "km км", "mm2": "mm2 мм2", "cm2": "cm2 см2", "m2": "m2 м2", "mm3": "mm3 мм3", "cm3": "cm3 см3", "m3": "m3 м3",
    "g": "g г", "kg": "kg кг", "t": "t т", "s": "s sec с сек", "min": "min мин", "h": "h hr ч час", "d": "d day д дн", "mL": "mL ml мл", "L": "L l л", "Hz": "Hz Гц", "kHz": "kHz кГц",
    "W": "W Вт", "kW": "kW кВт", "MW": "MW МВт", "V": "V В", "kV": "kV кВ", "A": "A А", "mA": "mA мА", "N": "N Н", "kN": "kN кН", "N*m": "N*m Н*м", "kN*m": "kN*m кН*м",
    "m/s": "m/s м/с", "m/s2": "m/s2 м/с2", "kg/m3": "kg/m3 кг/м3", "m3/h": "m3/h м3/ч", "L/min": "L/min л/мин", "rpm": "rpm об/мин",
}


def canonical(raw: Column) -> Column:
    """A matched number in canonical form: no thousands marks, a decimal point, no needless zeros, no sign of zero."""
    sign = F.regexp_extract(raw, r"^([+\-]?)", 1)
    body = F.regexp_replace(raw, r"^[+\-]", "")
    body = F.regexp_replace(body, r"[  ,](?=\d{3}(?:\D|$))", "")
    body = F.replace(body, F.lit(","), F.lit("."))
    body = F.when(body.contains("."), F.regexp_replace(F.regexp_replace(body, "0+$", ""), r"\.$", "")).otherwise(body)
    body = F.regexp_replace(body, "^0+", "")
    body = F.when(body == "", "0").otherwise(body)
    return F.when(body == "0", body).otherwise(F.concat(sign, body))


def numbers(text: Column) -> Column:
    """All numbers of a text in canonical form, repeats included; null text has none."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), FULL_WIDTH, PLAIN), F.lit(NUMBER), F.lit(0))
    return F.transform(found, canonical)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def multiset_difference(a: Column, b: Column) -> Column:
    """What array a has more of than array b, sorted."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))

    def more(s: Column) -> Column:
        repeated = F.transform(F.array_distinct(s["a"]), lambda v: F.array_repeat(v, F.greatest(count(s["a"], v) - count(s["b"], v), F.lit(0))))
        return F.array_sort(F.flatten(repeated))

    return let(F.struct(a.alias("a"), b.alias("b")), more)


def missing_numbers(source: Column, translated: Column) -> Column:
    """Numbers of the source that its translation lacks; a translation may have more."""
    return multiset_difference(numbers(source), numbers(translated))


def standards(text: Column) -> Column:
    """Numbers of standards that stand after a known prefix."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STANDARD), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[—–\s]", "-"), r"^[-.]+|[-.]+$", "")), lambda x: x != "")


def missing_standards(source: Column, translated: Column) -> Column:
    return multiset_difference(standards(source), standards(translated))


def unit_key(raw: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(raw), "²³·μ", "23*µ"), r"[ ^]", "")


def normalized_unit(raw: Column) -> Column:
    """The canonical unit; empty for an empty one, null for an unknown one. Case matters."""
    spellings = [F.lit(v) for name, all_of in UNITS.items() for s in all_of.split() for v in (s, name)]
    return let(unit_key(raw), lambda key: F.when(key == "", "").otherwise(F.try_element_at(F.create_map(*spellings), key)))


def strict_number(raw: Column, comma: str = "reject") -> Column:
    """A signed decimal in canonical form, null where the text isn't one or its comma may mean two things.

    ``comma`` settles a single comma before three digits: reject, decimal or thousands.
    """
    plain = F.trim(F.translate(raw, "０１２３４５６７８９−–—", "0123456789---"))
    shape = plain.rlike(r"^[+\-]?\s*\d+(?:[  ,]\d{3})*(?:[.,]\d+)?$")
    negative = plain.startswith("-")
    body = F.regexp_replace(plain, r"^[+\-]\s*|[  ]", "")
    commas = F.length(body) - F.length(F.replace(body, F.lit(","), F.lit("")))
    head, tail = F.substring_index(body, ",", 1), F.substring_index(body, ",", -1)
    unclear = (commas == 1) & (F.length(tail) == 3) & F.regexp_replace(head, "^0+", "").rlike(".")
    joined = F.replace(body, F.lit(","), F.lit(""))
    decimal = (
        F.when(body.contains("."), joined)
        .when(commas > 1, F.when(body.rlike(r"^\d+(,\d{3})+$"), joined))
        .when(commas == 0, body)
        .when(unclear, {"reject": F.lit(None).cast("string"), "decimal": F.concat(head, F.lit("."), tail), "thousands": joined}[comma])
        .otherwise(F.concat(head, F.lit("."), tail))
    )
    cut = F.when(decimal.contains("."), F.regexp_replace(F.regexp_replace(decimal, "0+$", ""), r"\.$", "")).otherwise(decimal)
    cut = F.regexp_replace(cut, r"^0+(?=\d)", "")
    return F.when(shape, F.when(cut == "0", cut).when(negative, F.concat(F.lit("-"), cut)).otherwise(cut))


def citations(text: Column, digits: int) -> Column:
    """Numbers in brackets of at most ``digits`` digits, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\[([0-9]{{1,{digits}}})\]"), F.lit(1)), lambda x: x.cast("int"))
