"""Splits of evaluated cases into a tuning and a locked part that share no document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .kept import kept
from .ordered import running_in_parts

#: Clusters up to which every subset is looked at.
EXHAUSTIVE = 18


def cluster_split(cases: DataFrame, labels: DataFrame, seed: int, fraction: float, exhaustive: int = EXHAUSTIVE) -> DataFrame:
    """(case, cluster, part): ``locked`` holds about ``fraction`` of the cases, ``tuning`` the others; cases that share a document, directly or through others, stay together.

    ``cases`` are (case, document), ``labels`` (case, label). A split is allowed if both parts have clusters and every label of two clusters or more is
    in both. The best is nearest to the wanted number of cases, then has the labels' shares of clusters nearest to those of all, then the
    smallest hash. Up to ``exhaustive`` clusters all their subsets are candidates, one row each; beyond, clusters are ordered by
    a hash with the seed and the candidates are the beginnings of that order, scored by running sums.
    A cluster is named by its least case.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    spark = cases.sparkSession
    of = kept(stats.shared_clusters(cases, "case", "document"))
    sizes = kept(of.groupBy("cluster").agg(F.count("*").alias("size")))
    marks = kept(labels.join(of, "case").select("cluster", "label").distinct())
    count, total = sizes.agg(F.count("*"), F.sum("size")).first()
    if count < 2:
        raise ValueError("a split needs two clusters or more")
    wanted = max(1, min(round(total * fraction), total - 1))
    shares = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a label
    if count <= exhaustive:
        order = [(str(r.cluster), r.size) for r in sizes.orderBy(F.col("cluster").cast("string")).collect()]
        place = {name: i for i, (name, _) in enumerate(order)}
        masks: dict[object, int] = dict.fromkeys(shares, 0)
        for r in marks.collect():
            masks[r.label] |= 1 << place[str(r.cluster)]
        subset = spark.range(1, (1 << count) - 1).select(F.col("id").alias("m"))
        bit = lambda i: F.shiftright("m", i).bitwiseAND(F.lit(1))
        chosen = F.bit_count("m")
        size = sum((bit(i) * n for i, (_, n) in enumerate(order)), F.lit(0))
        here = {label: F.bit_count(F.col("m").bitwiseAND(F.lit(mask))) for label, mask in masks.items()}
        names = F.array_join(F.array_compact(F.array(*(F.when(bit(i) == 1, F.lit(name)) for i, (name, _) in enumerate(order)))), ",")
        best = candidates(subset, size, here, shares, chosen, count, wanted).withColumn("tie", F.sha2(F.concat(F.lit(f"{seed}:"), names), 256)).orderBy("off", "error", "tie").limit(1).collect()
        locked = None if not best else [(name,) for i, (name, _) in enumerate(order) if best[0].m >> i & 1]
        picked = spark.createDataFrame(locked or [], "name string")
    else:
        wide = marks.groupBy("cluster").agg(F.collect_set("label").alias("have"))
        rows = sizes.join(wide, "cluster", "left").select(F.col("cluster").cast("string").alias("name"), "size", "have", F.lit(0).alias("all"))
        rows = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "name"), 256))
        named = {f"_l{i}": label for i, label in enumerate(sorted(shares, key=str))}
        has = {c: F.coalesce(F.array_contains("have", F.lit(label)), F.lit(False)).cast("long") for c, label in named.items()}
        run = kept(running_in_parts(rows, ["all"], ["h"], sums={"upto": F.col("size"), "chosen": F.lit(1).cast("long")} | has))
        here = {label: F.col(c) for c, label in named.items()}
        prefix = candidates(run.where(F.col("chosen") < count), F.col("upto"), here, shares, F.col("chosen"), count, wanted)
        best = prefix.withColumn("tie", F.sha2(F.concat(F.lit(f"{seed}:"), "name"), 256)).orderBy("off", "error", "tie").limit(1).collect()
        picked = run.where(F.col("chosen") <= (best[0].chosen if best else 0)).select("name")
    if not best:
        raise ValueError("no split has every label on both sides")
    part = F.when(F.col("name").isNotNull(), "locked").otherwise("tuning")
    return of.join(picked, of.cluster.cast("string") == picked.name, "left").select("case", "cluster", part.alias("part"))


def candidates(rows: DataFrame, size: Column, here: dict, shares: dict, chosen: Column, count: int, wanted: int) -> DataFrame:
    """``rows`` that are allowed splits, with off (cases too many or too few) and error (of the labels' shares)."""
    allowed, error = F.lit(True), F.lit(0.0)
    for label in sorted(shares, key=str):
        n = shares[label]
        if n > 1:
            allowed &= (here[label] > 0) & (here[label] < n)
        error = error + F.abs(here[label] / chosen - F.lit(n) / F.lit(count))
    return rows.where(allowed).withColumns({"off": F.abs(size - wanted), "error": F.round(error, 9)})
