"""Running sums and ranks within a few large keys, without a task that holds a key.

Rows of a key are cut into ranges of their order column by approximate quantiles; sums by range
give every range's offset, and only within a range are rows ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import measured

RANGES = 64


def running(rows: DataFrame, key: str, by: str, amount: Column, then: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``amount`` over the key's rows up to each in the order (by, *then).

    Equal values of ``by`` share a range; rows without one come last.
    """
    rows = rows.withColumn("_amount", amount)
    edges = rows.groupBy(key).agg(F.percentile_approx(F.col(by).cast("double"), [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_edges"))
    # One row a key of at most ``ranges`` numbers; Spark broadcasts it if there are few keys.
    cut = rows.join(edges.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    cut = cut.withColumn("_range", F.when(F.col(by).isNull(), ranges).otherwise(F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < F.col(by).cast("double"))))).drop("_edges")
    totals = cut.groupBy(key, "_range").agg(F.sum("_amount").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), before.alias("_before"))
    inner = Window.partitionBy(key, "_range").orderBy(F.col(by).asc_nulls_last(), *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumn("_inner", F.sum("_amount").over(inner))
    found = summed.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return found.withColumn("upto", F.col("_inner") + F.col("_before")).drop("_amount", "_range", "_inner", "_key", "_at", "_before")


def ranked_values(rows: DataFrame, key: str, value: str, ranges: int = RANGES) -> DataFrame:
    """(key, value, c, hi, n): each distinct value, how often it occurs, the rows up to it and all rows of the key."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    n = counted.groupBy(F.col(key).alias("_k")).agg(F.sum("c").alias("n"))
    found = running(counted, key, value, F.col("c"), (), ranges).withColumnRenamed("upto", "hi")
    return found.join(n, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def value_at(rank: Column, value: str) -> Column:
    """Aggregate over ``ranked_values``: the value of that rank (from 1)."""
    return F.max(F.when((F.col("hi") >= rank) & (F.col("hi") - F.col("c") < rank), F.col(value)))


def running_in_parts(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums and maxima over each key's rows up to the row itself, in the given order.

    Rows are range partitioned by key and order, so that a key of any size is spread over as many parts as it fills, and equal
    rows with it; a part's rows run by themselves, and what a key has in earlier parts is added from one row a key and part.
    """
    sums, maxima = sums or {}, maxima or {}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order, "_tie")]
    dealt = rows.withColumns({f"_{n}": c for n, c in (sums | maxima).items()} | {"_tie": F.monotonically_increasing_id()})
    dealt = measured(dealt.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part", *keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_c"), *(F.sum(f"_{n}").alias(f"_{n}") for n in sums), *(F.max(f"_{n}").alias(f"_{n}") for n in maxima))
    before = totals.select(F.col("_part").alias("_at"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.sum(f"_{n}").over(earlier).alias(f"_b{n}") for n in sums), *(F.max(f"_{n}").over(earlier).alias(f"_b{n}") for n in maxima))
    run = dealt.withColumns({n: F.sum(f"_{n}").over(inner) for n in sums} | {n: F.max(f"_{n}").over(inner) for n in maxima})
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    whole = {n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_b{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"_b{n}") for n in maxima}
    return run.join(before, same).withColumns(whole).select(*rows.columns, *sums, *maxima)
