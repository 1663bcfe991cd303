"""State machines as batch transitions: lease queue, approvals, versions, back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backoff(base: float, attempt: Column, cap: float) -> Column:
    """base * 2 ** (attempt - 1) seconds, at most ``cap``."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap)))


def due(jobs: DataFrame, now: Column) -> Column:
    """Queued jobs whose time has come and running ones whose lease has run out, with attempts left."""
    waiting = (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    return (waiting | lost) & (F.col("attempt") < F.col("max_attempts"))


def claimed(jobs: DataFrame, now: Column, worker: str, lease_seconds: int, most: int) -> DataFrame:
    """``jobs`` after a worker has claimed the ``most`` oldest that are due."""
    order = [F.asc_nulls_first("next_attempt_at"), F.asc("created_at"), F.asc("id")]
    chosen = jobs.where(due(jobs, now)).orderBy(*order).limit(most).select("id", F.lit(True).alias("mine"))
    lease = now + F.make_interval(secs=F.lit(lease_seconds))
    marked = jobs.join(chosen, "id", "left")
    mine = F.coalesce("mine", F.lit(False))
    return marked.select(
        "id", F.when(mine, "running").otherwise(F.col("status")).alias("status"), (F.col("attempt") + mine.cast("int")).alias("attempt"), "max_attempts", F.when(mine, F.lit(worker)).otherwise(F.col("token")).alias("token"), F.when(mine, lease).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"), "next_attempt_at", "created_at"
    )


def finished(jobs: DataFrame, results: DataFrame, now: Column, base: float, cap: float) -> DataFrame:
    """``jobs`` after results (id, token, ok): only a matching token counts; failures wait longer each time or give up."""
    r = results.select("id", F.col("token").alias("r_token"), "ok")
    joined = jobs.join(r, "id", "left")
    counts = F.coalesce((F.col("status") == "running") & (F.col("token") == F.col("r_token")), F.lit(False))
    again = F.col("attempt") < F.col("max_attempts")
    status = F.when(~counts, F.col("status")).when(F.col("ok"), "done").when(again, "queued").otherwise("failed")
    wait = F.when(counts & ~F.col("ok") & again, now + F.make_interval(secs=backoff(base, F.col("attempt"), cap)))
    return joined.select("id", status.alias("status"), "attempt", "max_attempts", F.when(~counts, F.col("token")).alias("token"), F.coalesce(wait, "next_attempt_at").alias("next_attempt_at"))


def approved(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``entries`` where only the last approved of each key stays approved; earlier ones are revoked. Null keys match null."""
    w = Window.partitionBy(*key, "status").orderBy(*(F.desc(c) for c in order))
    last = F.row_number().over(w) == 1
    return entries.withColumn("status", F.when((F.col("status") == "approved") & ~last, "revoked").otherwise(F.col("status")))
