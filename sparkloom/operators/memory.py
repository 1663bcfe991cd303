"""Scoped memory: the gate, caps, promotion and retention as side-effect-free transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items kept of each scope; fixed values.
CAPS = {"user": 5, "project": 5, "document": 4, "thread": 4, "summary": 3}


def fingerprint(kind: Column, scope: Column, structured: Column, content: Column) -> Column:
    """sha256 over kind, scope, structured part and the content in lower case with single spaces."""
    flat = F.trim(F.regexp_replace(F.lower(content), r"\s+", " "))
    return F.sha2(F.concat_ws("|", kind, scope, F.coalesce(structured, F.lit("")), flat), 256)


def gate(items: DataFrame, day: int, trust: float, relevance: float) -> DataFrame:
    """``items`` with blocked_by (the first failing rule) and reasons (all of them).

    The order is scope, validity, trust, sensitivity, relevance.
    """
    rules = {
        "scope": (F.col("scope") == "project") & F.col("project_id").isNull(),
        "validity": F.col("valid_day").isNotNull() & (F.col("valid_day") <= day),
        "trust": F.col("confidence") < trust,
        "sensitivity": F.col("sensitivity") == "secret",
        "relevance": F.col("relevance") < relevance,
    }
    reasons = F.array_compact(F.array(*(F.when(failed, name) for name, failed in rules.items())))
    return items.withColumn("reasons", reasons).withColumn("blocked_by", F.try_element_at("reasons", F.lit(1)))


def capped(items: DataFrame, by: list[str]) -> DataFrame:
    """Gated items within each scope's cap, best relevance first; the gate comes before the cap."""
    passed = items.where("blocked_by is null")
    order = Window.partitionBy(*by, "scope").orderBy(F.desc("relevance"), "id")
    cap = F.coalesce(F.create_map(*(F.lit(x) for kv in CAPS.items() for x in kv))[F.col("scope")], F.lit(0))
    return passed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap)


def promoted(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, key, content, valid_from, valid_to, supersedes): versions of each key after its candidates apply.

    ``candidates`` (key, id, action, content, at): create and supersede open a version and close
    the one before it, delete closes it; empty content is rejected.
    """
    accepted = candidates.where("action = 'delete' or trim(coalesce(content, '')) <> ''")
    events = items.select("key", "id", F.lit("create").alias("action"), "content", "at").unionByName(accepted.select("key", "id", "action", "content", "at"))
    w = Window.partitionBy("key").orderBy("at", "id")
    open_id = F.last(F.when(F.col("action") != "delete", F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    closed = F.lag("action").over(w) == "delete"
    versions = events.withColumn("valid_to", F.lead("at").over(w)).withColumn("supersedes", F.when(closed, None).otherwise(open_id))
    return versions.where("action <> 'delete'").select("id", "key", "content", F.col("at").alias("valid_from"), "valid_to", "supersedes")


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The union of both where the last of a key by ``order`` wins, incoming after stored."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_side"), *(F.desc(c) for c in order))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_side")
