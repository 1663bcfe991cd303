"""Operational series: rates, histogram quantiles, ratios, alerts, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the duration histogram in seconds; fixed values.
BOUNDS = (1.0, 5.0, 15.0, 60.0, 300.0, 900.0, 1800.0, 3600.0, float("inf"))


def rate(events: DataFrame, ts: str, label: str, seconds: int) -> DataFrame:
    """(start, label, n, rate): events per second in windows of ``seconds``."""
    start = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")["start"]
    return events.groupBy(start.alias("start"), label).agg(F.count("*").alias("n")).withColumn("rate", F.round(F.col("n") / seconds, 9))


def counter_rate(samples: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Increase of a counter per second over each key's samples; a fall is a reset, counted from zero."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = F.col(value) - F.lag(value).over(w)
    grown = F.when(step < 0, F.col(value)).otherwise(step)
    rows = samples.withColumn("grown", grown)
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    return rows.groupBy(*keys).agg(F.round(F.coalesce(F.sum("grown"), F.lit(0.0)), 6).alias("increase"), span.alias("seconds")).select(*keys, "increase", F.round(F.col("increase") / F.nullif(F.col("seconds"), F.lit(0.0)), 9).alias("rate"))


def histogram(events: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(keys, le, n): cumulative counts by upper bound; one aggregate, then unpivoted."""
    counts = events.groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))).alias("p")
    return counts.select(*keys, pairs).select(*keys, "p.le", "p.n")


def histogram_quantile(q: float, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, quantile): the first bucket that reaches q of the total, interpolated; the last finite bound in the infinite one."""
    w = Window.partitionBy(*keys).orderBy("le")
    rows = buckets.select(*keys, "le", "n", F.lag("le", 1, 0.0).over(w).alias("low"), F.lag("n", 1, 0).over(w).alias("below"), F.max("n").over(Window.partitionBy(*keys)).alias("total"))
    hit = rows.where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*keys, F.round(F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside), 6).alias("quantile"))


def clamped_ratio(part: Column, whole: Column, least: float = 0.001) -> Column:
    return part / F.greatest(whole.cast("double"), F.lit(least))


def sustained(windows: DataFrame, key: str, start: str, breach: Column, seconds: int, least: int) -> DataFrame:
    """(key, since, until, n): unbroken runs of at least ``least`` breached windows of ``seconds``."""
    hit = windows.where(breach).select(key, F.col(start).alias("t"))
    w = Window.partitionBy(key).orderBy("t")
    island = F.unix_seconds("t") - F.row_number().over(w) * seconds
    runs = hit.withColumn("island", island).groupBy(key, "island").agg(F.min("t").alias("since"), F.max("t").alias("until"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("island")


def staleness(last: Column, now: Column, ahead: int = 300) -> Column:
    """Seconds since ``last``: -1 where there is none, 0 where it lies over ``ahead`` seconds in the future."""
    age = F.unix_seconds(now) - F.unix_seconds(last.cast("timestamp"))
    return F.when(last.isNull(), -1).when(age < -ahead, 0).otherwise(F.greatest(age, F.lit(0)))
