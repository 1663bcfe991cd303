"""Queries: gold sets written from conversations as JSON lines, read back and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kept import kept
from ..sources import gold
from .registry import query, table
from .sinks import scratch

HEX = "a" * 64
#: Turns as gold cases, k telling what is wrong with each; shared by the SQL of all queries.
PLANTED = """WITH t AS (SELECT conv_id, turn, (conv_id * 5 + turn) % 17 AS k, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n, sha256(text) <> sha256(trim(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), ' ' || chr(9) || chr(10))) AS odd, text FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, unnest(list_filter([
 CASE WHEN k = 0 THEN {'place': 'record', 'rule': 'repeated key'} WHEN k = 10 THEN {'place': 'record', 'rule': 'json'} END,
 CASE WHEN k = 1 THEN {'place': 'evidence.0.page', 'rule': 'type'} END, CASE WHEN k = 2 THEN {'place': 'evidence.0.<field>', 'rule': 'unknown'} END, CASE WHEN k = 4 THEN {'place': 'language', 'rule': 'choice'} END,
 CASE WHEN k = 5 THEN {'place': 'answerable', 'rule': 'missing'} END, CASE WHEN k = 11 THEN {'place': 'question', 'rule': 'type'} WHEN k NOT IN (0, 10) AND (n < 8 OR n > 4000) THEN {'place': 'question', 'rule': 'length'} END], lambda x: x IS NOT NULL)) AS f FROM t),
s AS (SELECT * FROM t WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM f)),
g AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN odd THEN 'question_sha256' END, CASE WHEN k = 3 THEN 'bbox' END, CASE WHEN k = 6 THEN 'answer' END, CASE WHEN k = 6 THEN 'evidence_of_answer' END, CASE WHEN k = 7 THEN 'evidence_page' END,
 CASE WHEN k = 8 THEN 'evidence_id' END, CASE WHEN k = 9 THEN 'hop_evidence' END], lambda x: x IS NOT NULL)) AS rule FROM s),
u AS (SELECT * FROM s WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM g))"""


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, record, faults): every turn with a text as a case, its faults planted by its numbers, written as text and read back."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumn("k", (F.col("conv_id") * 5 + F.col("turn")) % 17)
    k = F.col("k")
    lone = k.isin(15, 16)  # cases without an answer
    page = F.when(k == 7, 99).otherwise(3)
    ref = F.concat(F.lit("ev-sha256:"), F.lit(HEX), F.lit(":p"), F.when(k == 8, 2).otherwise(page).cast("string"), F.lit(":text:"), F.lit("b" * 64))
    box = F.when(k == 3, F.array(*(F.lit(x) for x in (0.5, 0.0, 0.5, 1.0)))).when(k == 13, F.array(*(F.lit(x) for x in (0.0, 0.0, 0.5, 1.0))))
    evidence = F.struct(ref.alias("evidence_id"), F.lit(f"doc-sha256:{HEX}").alias("document_ref"), page.alias("page"), F.lit("text").alias("content_type"), F.lit("b" * 64).alias("content_sha256"), F.lit(2).alias("relevance_grade"), box.alias("bbox"))
    answer = F.concat_ws("-", F.lit("answer"), "conv_id", "turn")
    case = F.struct(
        F.lit("rag-gold-v1").alias("schema_version"), F.when(k == 12, "ragq-repeated0").otherwise(F.concat(F.lit("ragq-"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-"), F.col("turn").cast("string"))).alias("case_id"),
        F.lit("candidate").alias("status"), F.lit(f"scope-sha256:{HEX}").alias("scope_id"), F.when(k == 4, "xx").otherwise(F.element_at(F.array(*map(F.lit, gold.LANGUAGES)), (1 + k % 3).cast("int"))).alias("language"),
        F.when(k != 11, F.col("text")).alias("question"), F.sha2(F.col("text"), 256).alias("question_sha256"), (~lone & (k != 6)).alias("answerable"), F.when(~lone, answer).alias("reference_answer"), F.when(~lone, F.sha2(answer, 256)).alias("reference_answer_sha256"),
        F.when(k == 9, "multi").otherwise("single").alias("hop_type"), F.array(F.lit("text")).alias("content_types"), F.array(F.when(k == 14, "units").otherwise("numbers")).alias("challenge_tags"),
        F.array(F.struct(F.lit(f"doc-sha256:{HEX}").alias("document_ref"), F.lit(HEX).alias("source_sha256"), F.lit("c" * 64).alias("parsed_content_sha256"), F.lit(9).alias("page_count"))).alias("document_scope"),
        F.when(lone, F.array().cast("array<string>")).otherwise(F.array(F.lit("@"))).alias("evidence"), F.lit(None).cast("string").alias("review"),
    )
    keep = {"ignoreNullFields": "false"}
    # The evidence is put in as text, so that its page may be a string and its keys may differ.
    locator = F.to_json(evidence, keep)
    locator = F.when(k == 1, F.replace(locator, F.lit('"page":3'), F.lit('"page":"3"'))).when(k == 2, F.replace(locator, F.lit('"page":3'), F.lit('"page":3,"name":1'))).otherwise(locator)
    line = F.replace(F.to_json(case, keep), F.lit('["@"]'), F.concat(F.lit("["), locator, F.lit("]")))
    line = F.when(k == 0, F.concat(F.lit('{"status":"candidate",'), F.substr(line, F.lit(2)))).when(k == 5, F.replace(line, F.lit('"answerable":true,'))).when(k == 10, F.concat(line, F.lit(","))).otherwise(line)
    path = scratch(spark, "gold")
    rows.select(F.concat_ws("\t", "conv_id", "turn", line).alias("value")).write.text(path)
    told = spark.read.text(path).select(*(F.split_part("value", F.lit("\t"), F.lit(i)).cast("long").alias(n) for i, n in ((1, "conv_id"), (2, "turn"))), F.regexp_replace("value", r"^\d+\t\d+\t", "").alias("value"))
    return kept(gold.checked(told))


@query("src6_gold_faults", f"""{PLANTED} SELECT conv_id, turn, f.place AS place, f.rule AS rule FROM f UNION ALL SELECT conv_id, turn, 'record', rule FROM g
UNION ALL SELECT conv_id, turn, 'case_id', 'repeated' FROM u WHERE k = 12 AND (SELECT count(*) FROM u WHERE k = 12) > 1 UNION ALL SELECT conv_id, turn, 'question_sha256', 'repeated' FROM (SELECT *, count(*) OVER (PARTITION BY text) AS times FROM u) WHERE times > 1""")
def src6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of the gold cases by its place and rule."""
    return gold.faults(written(spark, sf_dir), ["conv_id", "turn"])


@query("src6_gold_report", f"""{PLANTED} SELECT count(*) AS records, count(*) FILTER (WHERE k IN (15, 16)) AS no_answer,
list_filter([CASE WHEN count(*) NOT BETWEEN 200 AND 500 THEN 'record_count' END, CASE WHEN count(*) FILTER (WHERE k = 12) > 1 THEN 'case_id' END, CASE WHEN count(DISTINCT text) < count(*) THEN 'question' END, CASE WHEN count(*) FILTER (WHERE k IN (15, 16)) < 0.2 * count(*) THEN 'no_answer_share' END,
 CASE WHEN count(DISTINCT k % 3) < 3 THEN 'languages' END, 'hop_types', 'content_types', 'challenge_tags'], lambda x: x IS NOT NULL) AS failures FROM u""")
def src6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound cases as a set: their number, those without an answer, and what the set lacks."""
    return gold.report(written(spark, sf_dir)).select("records", "no_answer", "failures")
