"""Claims: the sentences of an answer with their citations, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of sentences in Latin, Cyrillic and Chinese text; fixed values.
ENDS = ".!?。！？;；"
SPAN = rf"[^\n{ENDS}]+(?:[{ENDS}]+|(?=\n)|$)"
SOURCE_HEADINGS = ("источники", "sources", "来源")


def claim_spans(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, start, stop, raw, claim, cited, language, non_factual): one row per sentence; offsets count characters.

    Sentences are matched in order, so each begins where the text before it ends: the offset
    is found by locating the sentence after the end of the one before, in one fold per row.
    """
    raws = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SPAN), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<raw:string,start:int>>)").alias("out"))

    def place(acc: Column, raw: Column) -> Column:
        at = F.call_function("locate", raw, F.col(text), acc["at"])
        return F.struct((at + F.char_length(raw)).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(raw.alias("raw"), (at - 1).cast("int").alias("start")))).alias("out"))

    placed = answers.select(key, F.posexplode(F.aggregate(raws, start, place)["out"]).alias("n", "s"))
    visible = F.trim(F.regexp_replace("s.raw", r"(?U)^\s+|\s+$", ""))
    rows = placed.select(key, "n", "s.start", (F.col("s.start") + F.char_length("s.raw")).alias("stop"), F.col("s.raw").alias("raw"), visible.alias("visible")).where("visible <> ''")
    bare = F.trim(F.regexp_replace("visible", r"\[\d{1,3}\]", ""))
    claim = F.regexp_replace(F.regexp_replace(bare, r"^\s*(?:#{1,6}\s+|[-*•]\s+|\d{1,3}[.)]\s+)", ""), rf"[{ENDS[:-1]}]+$", "")
    cited = F.array_distinct(F.transform(F.regexp_extract_all("visible", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    rows = rows.withColumns({"claim": F.trim(claim), "cited": cited}).where("claim <> ''")
    language = F.when(F.col("claim").rlike("[㐀-鿿]"), "zh").when(F.col("claim").rlike("[А-Яа-яЁё]"), "ru").otherwise("en")
    heading = F.col("visible").startswith("#") | (F.col("claim").endswith(":") & (F.size("cited") == 0)) | F.lower("claim").isin(*SOURCE_HEADINGS)
    return rows.select(key, "n", "start", "stop", "raw", "claim", "cited", language.alias("language"), heading.alias("non_factual"))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` less disjoint spans (array of start and stop, in order), then with single blanks, at most one empty line in a row, trimmed."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["stop"].cast("int").alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, (s["start"] - acc["at"]).cast("int"))).alias("out"))
    left = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    left = F.regexp_replace(F.regexp_replace(left, r"[ \t]{2,}", " "), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")
    return F.regexp_replace(left, r"(?U)^\s+|\s+$", "")


def filtered_answers(answers: DataFrame, key: str, text: str, rejected: DataFrame) -> DataFrame:
    """``answers`` with ``text`` less the factual claims that ``rejected`` names by (key, n); all else stays as it is written.

    A key is one answer's; its spans are gathered in one row, as many as its text has sentences. A null text stays null.
    """
    factual = claim_spans(answers, key, text).where(~F.col("non_factual")).select(key, "n", "start", "stop")
    cuts = factual.join(rejected.select(key, "n").distinct(), [key, "n"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    spans = F.coalesce("_cuts", F.array().cast("array<struct<start:int,stop:int>>"))
    return answers.join(cuts, key, "left").withColumn(text, without_spans(F.col(text), spans)).drop("_cuts")
