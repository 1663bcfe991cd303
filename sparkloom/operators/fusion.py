"""Fusion and reranking of ranked lists (query_id, id, rank, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(lists: list[DataFrame], top: int, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rank, score): the sum of 1 / (k + rank) over the lists, ties by id."""
    every = reduce(DataFrame.unionByName, [df.select("query_id", "id", "rank") for df in lists])
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def blend(lexical: DataFrame, dense: DataFrame, w_lexical: float = 0.35, w_dense: float = 0.65) -> DataFrame:
    """(query_id, id, score): weighted sum of two scores, a missing side counting 0, to six digits."""
    a = lexical.select("query_id", "id", F.col("score").alias("a"))
    b = dense.select("query_id", "id", F.col("score").alias("b"))
    score = w_lexical * F.coalesce("a", F.lit(0.0)) + w_dense * F.coalesce("b", F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(score, 6).alias("score"))


def rerank(candidates: DataFrame, score: Column, least: float, keep: int) -> DataFrame:
    """Order by the scorer's value to four digits, ties by id; ``relevant`` tells whether a query's best reaches ``least``."""
    scored = candidates.withColumn("rerank_score", F.round(score, 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    return scored.withColumns({"relevant": best >= least, "position": F.row_number().over(order)}).where(F.col("position") <= keep)


def borda(rankings: DataFrame) -> DataFrame:
    """(query_id, id, points, position): consensus of complete rankings (query_id, ranker, id, rank) by the sum of ranks."""
    summed = rankings.groupBy("query_id", "id").agg(F.sum("rank").alias("points"))
    return summed.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("points", "id")))


def pairwise_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, n_common, agreement): concordant share of the pairs of items that both short lists rank.

    Lists are bounded by their top-k, so the pairs of a query are bounded by k * k / 2.
    """
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"])
    other = both.select("query_id", F.col("id").alias("id2"), F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    pairs = both.join(other, "query_id").where("ra < ra2")
    agree = pairs.groupBy("query_id").agg(F.round(F.avg((F.col("rb") < F.col("rb2")).cast("double")), 6).alias("agreement"))
    n = both.groupBy("query_id").agg(F.count("*").alias("n_common"))
    return n.join(agree, "query_id", "left")
