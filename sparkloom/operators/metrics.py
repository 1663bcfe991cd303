"""Ranking metrics over rankings (case_id, rank, ref) and grades (case_id, ref, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def ranking_metrics(rankings: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(case_id, n_relevant, recall, mrr, ndcg) at k for every case that has a relevant ref.

    A ref is relevant where its grade is positive. Gains are 2^grade - 1, discounts
    log2(rank + 1); the ideal order takes the k best of all positive grades.
    """
    good = grades.where("grade > 0").select("case_id", "ref", "grade")
    order = Window.partitionBy("case_id").orderBy(F.desc("grade"), "ref")
    total = good.groupBy("case_id").agg(F.count("*").alias("n_relevant"))
    ideal = good.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).groupBy("case_id").agg(F.sum(gain(F.col("grade")) / log2(F.col("i") + 1.0)).alias("idcg"))
    hits = rankings.where(F.col("rank") <= k).join(good, ["case_id", "ref"]).groupBy("case_id").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(gain(F.col("grade")) / log2(F.col("rank") + 1.0)).alias("dcg")
    )
    joined = total.join(ideal, "case_id").join(hits, "case_id", "left")
    return joined.select(
        "case_id", "n_relevant", F.round(F.coalesce("hits", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6).alias("ndcg")
    )


def class_metrics(ranked: DataFrame, cases: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``ranking_metrics`` where all other items of a case's label are relevant, without a row for each such pair.

    ``ranked`` has (case_id, rank, ref), ``cases`` (case_id, label), a case being an item itself, ``items`` (ref, label, grade).
    A label's k + 1 best items give the ideal order of each of its cases.
    """
    n = items.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    best = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("grade"), "ref"))
    tops = items.withColumn("i", best).where(F.col("i") <= k + 1).select("label", "ref", "grade")
    order = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "ref"))
    ideal = cases.join(tops, "label").where("ref <> case_id").withColumn("i", order).where(F.col("i") <= k).groupBy("case_id").agg(F.sum(gain(F.col("grade")) / log2(F.col("i") + 1.0)).alias("idcg"))
    found = ranked.where(F.col("rank") <= k).join(cases, "case_id").join(items, ["ref", "label"])
    hits = found.groupBy("case_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(gain(F.col("grade")) / log2(F.col("rank") + 1.0)).alias("dcg"))
    joined = cases.join(n, "label").where("n_relevant > 0").join(ideal, "case_id").join(hits, "case_id", "left")
    return joined.select(
        "case_id", "n_relevant", F.round(F.coalesce("hits", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6).alias("ndcg")
    )


def citation_metrics(citations: DataFrame, sources: DataFrame, relevant: DataFrame) -> DataFrame:
    """Validity, precision, recall and F1 of citations (case_id, cited) against sources (case_id, rank, ref) and relevant (case_id, ref).

    Validity counts mentions; precision counts distinct valid ranks that hold a relevant ref;
    recall the distinct relevant refs of all valid ranks.
    """
    known = sources.groupBy("case_id", F.col("rank").alias("cited")).agg(F.count("*").alias("n_refs"))
    mentions = citations.join(known, ["case_id", "cited"], "left")
    per = mentions.groupBy("case_id").agg(F.count("*").alias("mentions"), F.count("n_refs").alias("valid"), F.array_sort(F.collect_set(F.when(F.col("n_refs").isNull(), F.col("cited")))).alias("invalid"))
    distinct = citations.distinct().join(sources.withColumnRenamed("rank", "cited"), ["case_id", "cited"])
    marked = distinct.join(relevant.withColumn("good", F.lit(1)), ["case_id", "ref"], "left")
    ranks = marked.groupBy("case_id", "cited").agg(F.max(F.coalesce("good", F.lit(0))).alias("hit")).groupBy("case_id").agg(F.count("*").alias("unique"), F.sum("hit").alias("hits"))
    refs = marked.where("good = 1").select("case_id", "ref").distinct().groupBy("case_id").agg(F.count("*").alias("found"))
    wanted = relevant.distinct().groupBy("case_id").agg(F.count("*").alias("wanted"))
    joined = per.join(ranks, "case_id", "left").join(refs, "case_id", "left").join(wanted, "case_id", "left").na.fill(0, ["unique", "hits", "found", "wanted"])
    p = F.when(F.col("unique") == 0, 0.0).otherwise(F.col("hits") / F.col("unique"))
    r = F.when(F.col("wanted") == 0, 0.0).otherwise(F.col("found") / F.col("wanted"))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return joined.select("case_id", F.round(F.col("valid") / F.col("mentions"), 6).alias("validity"), F.round(p, 6).alias("precision_"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "invalid", F.col("unique").alias("n_unique"))


def risk_coverage(claims: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, coverage, precision_): of claims (score, supported), those at or above each threshold; one pass."""
    at = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    rows = claims.groupBy("score", "supported").agg(F.count("*").alias("n")).select("*", at)
    kept = F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("n")).otherwise(0))
    good = F.sum(F.when((F.col("score") >= F.col("threshold")) & F.col("supported"), F.col("n")).otherwise(0))
    out = rows.groupBy("threshold").agg(kept.alias("kept"), good.alias("good"), F.sum("n").alias("n"))
    return out.select("threshold", F.round(F.col("kept") / F.col("n"), 6).alias("coverage"), F.when(F.col("kept") > 0, F.round(F.col("good") / F.col("kept"), 6)).alias("precision_"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test, ties left out: min(1, 2 P(X <= min(wins, losses))), X binomial with p = 1/2."""
    n, m = (wins + losses).cast("double"), F.least(wins, losses).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log_p"), F.exp(-n * F.log(F.lit(2.0))).alias("tail"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log((n - k + 1) / k)
        return F.struct(log_p.alias("log_p"), (acc["tail"] + F.exp(log_p)).alias("tail"))

    tail = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), start, step)["tail"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def peak_concurrency(intervals: DataFrame, key: str) -> DataFrame:
    """(key, peak): most intervals (start, stop) open at once; at equal times starts come first."""
    ends = intervals.select(key, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.t", "e.d")
    steps = ends.groupBy(key, "t", "d").agg(F.sum("d").alias("s"))
    # Few keys have very many ends each: running sums go by ranges of time.
    return running(steps.withColumn("later", -F.col("d")), key, "t", F.col("s"), ("later",)).groupBy(key).agg(F.max("upto").alias("peak"))
