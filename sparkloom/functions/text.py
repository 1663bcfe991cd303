"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    """Trimmed, with single spaces for white space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_key(text: Column) -> Column:
    """Lower-case digits and Latin or Cyrillic letters only."""
    return F.regexp_replace(F.lower(text), "[^0-9a-zа-яё]", "")


def citation_count(text: Column, digits: int) -> Column:
    """Number of bracketed citations of at most ``digits`` digits; callers differ in the width they allow."""
    return F.regexp_count(text, F.lit(rf"\[[0-9]{{1,{digits}}}\]"))


def session_title(text: Column, most: int) -> Column:
    return F.substring(F.trim(text), 1, most)


def claim_language(text: Column) -> Column:
    """zh where any Han character occurs, else ru where any Cyrillic one does, else en."""
    return F.when(text.rlike("[一-鿿]"), "zh").when(text.rlike("[Ѐ-ӿ]"), "ru").otherwise("en")


def document_language(text: Column) -> Column:
    """By counts: zh from a tenth of Han characters on, ru where Cyrillic letters are no fewer than Latin ones, else en."""
    han, cyrillic, latin = (F.regexp_count(text, F.lit(p)) for p in ("[一-鿿]", "[Ѐ-ӿ]", "[A-Za-z]"))
    total = han + cyrillic + latin
    return F.when((total > 0) & (han >= 0.1 * total), "zh").when((cyrillic > 0) & (cyrillic >= latin), "ru").otherwise("en")


def is_caption(text: Column) -> Column:
    return F.lower(text).rlike(r"^(table|figure|fig\.) [0-9]")


def latin_only(text: Column) -> Column:
    """Three Latin words or more and no Cyrillic or Han character."""
    return (F.regexp_count(text, F.lit("[A-Za-z]+")) >= 3) & ~text.rlike("[Ѐ-ӿ一-鿿]")


def formula_guard(cell: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(cell.rlike("^[=+@-]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def normalized_number(raw: Column) -> Column:
    """A decimal number without plus, leading or trailing zeros, and without minus zero."""
    plain = F.regexp_replace(raw, r"^\+", "")
    plain = F.regexp_replace(plain, r"^(-?)0+([0-9])", "$1$2")
    plain = F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    return F.when(plain == "-0", "0").otherwise(plain)


def anchors(text: Column, size: int, step: int) -> Column:
    """Distinct windows of ``size`` words every ``step`` words, the last full one included; short texts give one."""
    words = F.array_remove(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), "")
    last = F.greatest(F.size(words) - (size - 1), F.lit(1))
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(1), last, F.lit(step)), lambda i: i < last), F.array(last)))
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))))


def match_form(text: Column) -> Column:
    """Lower-case Latin and Cyrillic letters and digits, in words."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "[^0-9a-zA-Zа-яА-ЯёЁ]+", " ")), " +", " "))


def has_heading_number(text: Column, number: str) -> Column:
    """Whether a heading begins with that number, as a whole."""
    return text.rlike(rf"^[ ]*{number}[.) ]")


def has_marker(text: Column, markers: list[str], empty_too: bool = False) -> Column:
    """Whether a text, case and white space aside, holds one of the markers; an empty one where asked."""
    plain = collapsed(F.lower(text))
    found = F.lit(False)
    for m in markers:
        found = found | plain.contains(m)
    return found | (plain == "") if empty_too else found


def embedding_input(text: Column, most: int, prefix: str = "") -> Column:
    """The trimmed text of at most ``most`` characters, a full stop where it is empty, behind the prefix, which isn't repeated."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    if prefix:
        raw = F.when(F.lower(raw).startswith(prefix.lower()), F.ltrim(F.substring(raw, len(prefix) + 1, 1 << 30))).otherwise(raw)
    body = F.substring(raw, 1, most)
    body = F.when(body == "", ".").otherwise(body)
    return F.concat(F.lit(f"{prefix} "), body) if prefix else body


def scope_id(owner: Column) -> Column:
    return F.concat(F.lit("scope-sha256:"), F.sha2(owner, 256))


def evidence_id(sha256: Column, page: Column, content_type: Column) -> Column:
    return F.concat(F.lit("ev-sha256:"), sha256, F.lit(":p"), page, F.lit(":"), content_type)
