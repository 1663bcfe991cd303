"""Statistics over paired cases: cluster bootstrap and clusters of cases that share documents."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seed_of(base: int, *parts: str) -> int:
    """A seed of its own for every named statistic."""
    return base ^ int.from_bytes(hashlib.sha256(":".join(parts).encode()).digest()[:8], "big")


def quantile(ordered: list[float], q: float) -> float:
    """Linear interpolation at (n - 1) q."""
    at = (len(ordered) - 1) * q
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


def cluster_bootstrap(rows: DataFrame, key: str, samples: int, seed: int, level: float = 0.95) -> DataFrame:
    """(key, baseline, candidate, improvement, low, high, clusters) from rows (key, cluster_id, baseline, candidate).

    Rows are reduced to one sum and count per cluster before any group meets in a task;
    clusters are drawn with replacement by Python's generator, in the order of their id. A
    key with fewer than two clusters has no interval.
    """
    per = rows.groupBy(key, "cluster_id").agg(F.sum("baseline").alias("b"), F.sum("candidate").alias("c"), F.sum(F.col("candidate") - F.col("baseline")).alias("d"), F.count("*").alias("n"))
    kind = rows.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster_id")
        name, n = pdf[key].iloc[0], int(pdf["n"].sum())
        base, cand = pdf["b"].sum() / n, pdf["c"].sum() / n
        low = high = None
        if len(pdf) > 1:
            clusters = list(zip(pdf["d"].tolist(), pdf["n"].tolist()))
            rng = random.Random(seed_of(seed, str(name)))
            drawn = []
            for _ in range(samples):
                picked = [clusters[rng.randrange(len(clusters))] for _ in clusters]
                drawn.append(sum(s for s, _ in picked) / sum(m for _, m in picked))
            drawn.sort()
            low, high = quantile(drawn, (1 - level) / 2), quantile(drawn, (1 + level) / 2)
        return pd.DataFrame([(name, base, cand, cand - base, low, high, len(pdf))], columns=[key, "baseline", "candidate", "improvement", "low", "high", "clusters"])

    return per.groupBy(key).applyInPandas(one, f"{key} {kind}, baseline double, candidate double, improvement double, low double, high double, clusters int")


def shared_clusters(cases: DataFrame, case_col: str, document_col: str, rounds: int = 30) -> DataFrame:
    """(case, cluster): cases that share a document, directly or through others; the cluster is the least case.

    Minimum labels travel from cases to documents and back, both ways by aggregates, until
    nothing changes; every round's result is checkpointed.
    """
    edges = cases.select(F.col(case_col).alias("case"), F.col(document_col).alias("document")).distinct()
    labels = edges.groupBy("case").agg(F.min("case").alias("cluster"))
    for _ in range(rounds):
        by_document = edges.join(labels, "case").groupBy("document").agg(F.min("cluster").alias("cluster"))
        new = edges.join(by_document, "document").groupBy("case").agg(F.min("cluster").alias("cluster"))
        # A label's own label: long chains halve in length every round.
        jumped = new.join(new.select(F.col("case").alias("cluster"), F.col("cluster").alias("next")), "cluster", "left")
        new = jumped.select("case", F.least("cluster", F.coalesce("next", "cluster")).alias("cluster"))
        new = new.checkpoint() if cases.sparkSession.sparkContext.getCheckpointDir() else new.persist()
        changed = new.join(labels.withColumnRenamed("cluster", "old"), "case").where("cluster <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise ValueError(f"clusters still change after {rounds} rounds; ask for more")
