"""Gold sets: strict JSON lines of question cases, each fault named by line, place and rule, never by a private value."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import json_problem

# Fixed values of the format: classes, patterns and bounds.
LANGUAGES = ("ru", "en", "zh")
HOPS = ("single", "multi", "cross_document")
CONTENTS = ("text", "table", "formula", "figure", "scan")
CHALLENGES = ("numbers", "units", "standards", "prompt_injection", "leakage")
SHA = "^[0-9a-f]{64}$"
DOCUMENT = "^doc-sha256:[0-9a-f]{64}$"
EVIDENCE = "^ev-sha256:[0-9a-f]{64}:p[1-9][0-9]*:(?:text|table|formula|figure|scan):[0-9a-f]{64}$"
AWARE_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"
LINE_BYTES = 256 * 1024


@dataclass(frozen=True)
class Field:
    """A key of an object: its kind, whether null will do, and bounds (of a string's or list's length, or an integer's value)."""

    name: str
    kind: str  # string, time, int, boolean, box, choices, object, objects
    null: bool = False
    pattern: str | None = None
    choices: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None
    fields: tuple["Field", ...] = ()


SNAPSHOT = (Field("document_ref", "string", pattern=DOCUMENT), Field("source_sha256", "string", pattern=SHA), Field("parsed_content_sha256", "string", pattern=SHA), Field("page_count", "int", least=1, most=100_000))
LOCATOR = (
    Field("evidence_id", "string", pattern=EVIDENCE), Field("document_ref", "string", pattern=DOCUMENT), Field("page", "int", least=1, most=100_000), Field("content_type", "string", choices=CONTENTS),
    Field("content_sha256", "string", pattern=SHA), Field("relevance_grade", "int", least=1, most=3), Field("bbox", "box", null=True),
)
REVIEW = (Field("reviewer_id", "string", pattern="^[a-z0-9][a-z0-9._-]{2,63}$"), Field("reviewed_at", "time", pattern=AWARE_TIME), Field("case_sha256", "string", pattern=SHA))
RECORD = (
    Field("schema_version", "string", choices=("rag-gold-v1",)), Field("case_id", "string", pattern="^ragq-[a-z0-9][a-z0-9._-]{7,63}$"), Field("status", "string", choices=("candidate", "reviewed")), Field("scope_id", "string", pattern="^scope-sha256:[0-9a-f]{64}$"),
    Field("language", "string", choices=LANGUAGES), Field("question", "string", least=8, most=4_000), Field("question_sha256", "string", pattern=SHA), Field("answerable", "boolean"),
    Field("reference_answer", "string", null=True, most=16_000), Field("reference_answer_sha256", "string", null=True, pattern=SHA), Field("hop_type", "string", choices=HOPS),
    Field("content_types", "choices", choices=CONTENTS, least=1, most=5), Field("challenge_tags", "choices", choices=CHALLENGES, most=5), Field("document_scope", "objects", fields=SNAPSHOT, least=1, most=64),
    Field("evidence", "objects", fields=LOCATOR, most=16), Field("review", "object", null=True, fields=REVIEW),
)
TYPES = {"string": "string", "time": "string", "int": "int", "boolean": "boolean", "box": "array<double>", "choices": "array<string>"}
KINDS = {"string": str, "time": str, "int": int, "boolean": bool, "box": list, "choices": list, "objects": list, "object": dict}
FAULT = T.StructType([T.StructField("place", T.StringType()), T.StructField("rule", T.StringType())])
JUDGED = T.StructType([T.StructField("faults", T.ArrayType(FAULT)), *(T.StructField(n, T.StringType()) for n in ("question", "answer", "case"))])


def schema(fields: tuple[Field, ...] = RECORD) -> str:
    """The fields as a struct's type."""
    kind = {"object": "{}", "objects": "array<{}>"}
    return "struct<" + ",".join(f"{f.name}:{kind[f.kind].format(schema(f.fields)) if f.fields else TYPES[f.kind]}" for f in fields) + ">"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files with their numbers from 1; a file may be read in many splits.

    A split's lines get consecutive ids in its task; only the splits' row counts are summed in
    order, one row a split, and joined back.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(starts, ["path", "block"]).select("path", (F.col("id") + F.col("shift") + 1).alias("line"), "value")


def value_rule(value, f: Field) -> str | None:
    """The rule that a value of the right type breaks, if any."""
    size, name = None, "length"
    if f.kind in ("string", "time"):
        value = value.strip()
        if f.pattern and not re.fullmatch(f.pattern, value):
            return "pattern"
        if f.choices and value not in f.choices:
            return "choice"
        if f.kind == "time":
            try:
                datetime.fromisoformat(value)
            except ValueError:
                return "time"
        size = len(value)
    elif f.kind == "int":
        size, name = value, "range"
    elif f.kind in ("choices", "objects"):
        if f.kind == "choices" and any(not isinstance(x, str) or x.strip() not in f.choices for x in value):
            return "choice"
        size = len(value)
    elif f.kind == "box" and (len(value) != 4 or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value)):
        return "box"
    low = f.least is not None and size < f.least
    return name if low or f.most is not None and size > f.most else None


def object_faults(value: dict, fields: tuple[Field, ...], at: str = "") -> list[tuple[str, str]]:
    """(place, rule) of an object's faults; an unknown key is named ``<field>``, since its name may be private."""
    found = []
    for f in fields:
        place, item = at + f.name, value.get(f.name)
        if item is None:
            if f.name not in value or not f.null:
                found.append((place, "type" if f.name in value else "missing"))
            continue
        if not isinstance(item, KINDS[f.kind]) or isinstance(item, bool) != (f.kind == "boolean"):
            found.append((place, "type"))
            continue
        if rule := value_rule(item, f):
            found.append((place, rule))
        if f.kind == "object":
            found += object_faults(item, f.fields, f"{place}.")
        for i, part in enumerate(item if f.kind == "objects" else ()):
            found += object_faults(part, f.fields, f"{place}.{i}.") if isinstance(part, dict) else [(f"{place}.{i}", "type")]
    if set(value) - {f.name for f in fields}:
        found.append((f"{at}<field>", "unknown"))
    return found


def line_faults(line: str | None) -> list[tuple[str, str]]:
    """Faults of a line by itself: blank, too long, not strict JSON, or those of its fields."""
    if not (line or "").strip():
        return [("record", "blank")]
    if len(line.encode()) > LINE_BYTES:
        return [("record", "size")]
    if problem := json_problem(line):
        return [("record", problem if problem == "repeated key" else "json")]
    value = json.loads(line)
    return object_faults(value, RECORD) if isinstance(value, dict) else [("record", "type")]


def normalized(text: str) -> str:
    """Text as it is hashed: composed, with plain line ends, stripped."""
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def case_sha256(line: str) -> str:
    """The hash of a case's canonical JSON without its status and review."""

    def plain(value, key=None):
        if isinstance(value, dict):
            return {k: plain(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [float(v) if key == "bbox" else plain(v) for v in value]
        return value.strip() if isinstance(value, str) else value

    case = {k: plain(v, k) for k, v in json.loads(line).items() if k not in ("status", "review")}
    return hashlib.sha256(json.dumps(case, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def text_sha256(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(normalized(text).encode()).hexdigest()


@F.pandas_udf(JUDGED)
def _judged(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        faults = line_faults(line)
        case = {} if faults else json.loads(line)
        hashes = (text_sha256(case["question"]), text_sha256(case["reference_answer"]), case_sha256(line)) if case else (None, None, None)
        out.append(([{"place": p, "rule": r} for p, r in faults], *hashes))
    return pd.DataFrame(out, columns=["faults", "question", "answer", "case"])


def record_rules(r: Column) -> dict[str, Column]:
    """What must hold among the fields of a sound record; hashes stand beside it in ``judged``."""
    distinct = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    evidence, scope = r["evidence"], r["document_scope"]
    pages = F.map_from_entries(F.transform(scope, lambda d: F.struct(d["document_ref"], d["page_count"])))
    inside = F.transform(scope, lambda d: d["document_ref"])
    refs = F.transform(evidence, lambda e: e["document_ref"])
    unique = distinct(inside)
    box = lambda b: F.forall(b, lambda x: x.between(0, 1)) & (b[0] < b[2]) & (b[1] < b[3])
    located = lambda e: F.concat(F.lit("ev-sha256:"), F.substring(e["document_ref"], 12, 64), F.lit(":p"), e["page"].cast("string"), F.lit(":"), e["content_type"], F.lit(":"), e["content_sha256"])
    answered, answer, answer_hash = r["answerable"], r["reference_answer"], r["reference_answer_sha256"]
    few = F.when(r["hop_type"] == "multi", F.size(evidence) >= 2).when(r["hop_type"] == "cross_document", F.size(F.array_distinct(refs)) >= 2).otherwise(True)
    review = r["review"]
    return {
        "document_ref": F.forall(scope, lambda d: d["document_ref"] == F.concat(F.lit("doc-sha256:"), d["source_sha256"])),
        "evidence_id": F.forall(evidence, lambda e: e["evidence_id"] == located(e)),
        "bbox": F.forall(evidence, lambda e: e["bbox"].isNull() | box(e["bbox"])),
        "question_sha256": r["question_sha256"] == F.col("judged.question"),
        "content_types_unique": distinct(r["content_types"]),
        "challenge_tags_unique": distinct(r["challenge_tags"]),
        "document_scope_unique": unique,
        "evidence_unique": distinct(F.transform(evidence, lambda e: e["evidence_id"])),
        "evidence_in_scope": F.size(F.array_except(refs, inside)) == 0,
        "evidence_page": ~unique | F.forall(evidence, lambda e: F.coalesce(e["page"] <= F.when(unique, pages)[e["document_ref"]], F.lit(True))),
        "evidence_content_type": F.size(F.array_except(F.transform(evidence, lambda e: e["content_type"]), r["content_types"])) == 0,
        "answer": F.when(answered, answer.isNotNull() & answer_hash.isNotNull()).otherwise(answer.isNull() & answer_hash.isNull()),
        "answer_sha256": ~answered | answer.isNull() | answer_hash.isNull() | (answer_hash == F.col("judged.answer")),
        "evidence_of_answer": answered == (F.size(evidence) > 0),
        "hop_evidence": ~answered | few,
        "leakage_refused": ~(answered & F.array_contains(r["challenge_tags"], "leakage")),
        "review": F.when(r["status"] == "candidate", review.isNull()).otherwise(review.isNotNull()),
        "case_sha256": (r["status"] == "candidate") | review.isNull() | (review["case_sha256"] == F.col("judged.case")),
    }


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``value``) and (record, faults): a line without faults has its record, any other its faults.

    A blank, oversized or unparsable line has that fault alone; fields are judged next; the rules
    among fields only where every field is sound. A null line counts as blank.
    """
    rows = rows.withColumn("judged", _judged("value"))
    rows = rows.withColumn("record", F.when(F.size("judged.faults") == 0, F.from_json("value", schema())))
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit("record").alias("place"), F.lit(name).alias("rule"))) for name, holds in record_rules(F.col("record")).items())))
    rows = rows.withColumn("faults", F.when(F.col("record").isNull(), F.col("judged.faults")).otherwise(broken))
    return rows.withColumn("record", F.when(F.size("faults") == 0, F.col("record"))).drop("judged")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, place, rule): sound records that share a case id or a question with another; counted by aggregates, joined by key."""
    sound = rows.where("record is not null")
    found = []
    for name in ("case_id", "question_sha256"):
        mine = sound.select(*keys, F.col(f"record.{name}").alias("shared"))
        often = mine.groupBy("shared").agg(F.count("*").alias("n")).where("n > 1")
        found.append(mine.join(often, "shared", "left_semi").select(*keys, F.lit(name).alias("place"), F.lit("repeated").alias("rule")))
    return found[0].unionByName(found[1])


def faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, place, rule) of every fault of ``checked`` rows, repeated cases included."""
    return rows.select(*keys, F.explode("faults").alias("f")).select(*keys, "f.place", "f.rule").unionByName(repeated(rows, keys))


def report(rows: DataFrame, release: bool = False, least: int = 200, most: int = 500, unanswered: float = 0.2) -> DataFrame:
    """One row (records, no_answer, counts, failures) of the sound records of ``checked`` rows.

    A leakage probe is no case without an answer. Every class must occur (five times for a
    release, where all cases must be reviewed too). Counts are partial aggregates over the classes.
    """
    r = F.col("record")
    required = {"languages": LANGUAGES, "hop_types": HOPS, "content_types": CONTENTS, "challenge_tags": CHALLENGES}
    values = {"languages": F.array(r["language"]), "hop_types": F.when(r["answerable"], F.array(r["hop_type"])).otherwise(F.array()), "content_types": r["content_types"], "challenge_tags": r["challenge_tags"]}
    sound = rows.where("record is not null")
    names = {(d, v): f"{d}:{v}" for d, all_values in required.items() for v in all_values}
    sums = [F.count_if(F.array_contains(values[d], v)).alias(n) for (d, v), n in names.items()]
    lonely = ~r["answerable"] & ~F.array_contains(r["challenge_tags"], "leakage")
    totals = sound.agg(F.count("*").alias("records"), F.count_if(lonely).alias("no_answer"), F.count_if(r["status"] != "reviewed").alias("open"), F.count_distinct("record.case_id").alias("ids"), F.count_distinct("record.question_sha256").alias("questions"), *sums)
    few = 5 if release else 1
    short = {d: F.size(F.filter(F.array(*(F.col(f"`{n}`") for (e, _), n in names.items() if e == d)), lambda n: n < few)) > 0 for d in required}
    rules = {"record_count": ~F.col("records").between(least, most), "case_id": F.col("ids") < F.col("records"), "question": F.col("questions") < F.col("records"), "no_answer_share": F.col("no_answer") < unanswered * F.col("records"), **short}
    if release:
        rules["not_reviewed"] = F.col("open") > 0
    failures = F.array_compact(F.array(*(F.when(bad, n) for n, bad in rules.items())))
    counts = F.map_from_arrays(F.array(*(F.lit(n) for n in names.values())), F.array(*(F.col(f"`{n}`") for n in names.values())))
    return totals.select("records", "no_answer", counts.alias("counts"), failures.alias("failures"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_hashes(texts: pd.Series) -> pd.Series:
    """The hash of every text of a row's list, as gold cases hash them."""
    return texts.map(lambda ts: None if ts is None else [text_sha256(t) for t in ts])
