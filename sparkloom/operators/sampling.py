"""Deterministic sampling and corpus construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_rank(seed: str, value: Column) -> Column:
    """A sort key that looks random and never changes: sha256 of seed:value."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)


def round_robin(rows: DataFrame, group: str, id_col: str, seed: str) -> DataFrame:
    """(group, id, turn): every group's rows by stable rank; sort by (turn, group's rank) to interleave groups."""
    w = Window.partitionBy(group).orderBy(stable_rank(seed, F.col(id_col)), id_col)
    return rows.select(group, id_col, F.row_number().over(w).alias("turn"), stable_rank(seed, F.col(group)).alias("group_rank"))


def token_set(text: Column, stopwords: list[str], least: int = 3) -> Column:
    """Distinct lower-case words of ``least`` letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= least)), F.array(*(F.lit(s) for s in stopwords)))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets; null where one is null or empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.sqrt(F.size(a).cast("double") * F.size(b)), F.lit(0.0))


def gap_pairs(rows: DataFrame, group: str, order: str, tokens: str, gaps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(group, a, b, gap, score): rows of a group a few places apart, by set cosine + 0.1 / gap."""
    w = Window.partitionBy(group).orderBy(order)
    wide = rows.select(group, F.col(order).alias("a"), tokens, *(F.lead(order, g).over(w).alias(f"b{g}") for g in gaps), *(F.lead(tokens, g).over(w).alias(f"t{g}") for g in gaps))
    ahead = F.explode(F.array(*(F.struct(F.lit(g).alias("gap"), F.col(f"b{g}").alias("b"), F.col(f"t{g}").alias("bt")) for g in gaps))).alias("p")
    pairs = wide.select(group, "a", tokens, ahead).where("p.b is not null")
    return pairs.select(group, "a", "p.b", "p.gap", F.round(F.coalesce(set_cosine(F.col(tokens), F.col("p.bt")), F.lit(0.0)) + 0.1 / F.col("p.gap"), 6).alias("score"))


def stratified(rows: DataFrame, stratum: str, id_col: str, n: int, seed: str) -> DataFrame:
    """The n rows of each stratum of least stable rank."""
    w = Window.partitionBy(stratum).orderBy(stable_rank(seed, F.col(id_col)), id_col)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
