"""Bootstrap intervals of paired metrics, drawn by the Mersenne Twister as Python's ``random`` draws.

Rows are summed by Spark to one row a unit (a cluster, or a case); these are counted first and, up to ``UNITS`` of
them, sent to all tasks. Replicates are dealt to tasks: a task runs through the numbers of its generator without
evaluating those of earlier replicates, so that all of them together are the replicates of one generator. More clusters than that are
resampled by Poisson weights (``evaluation.bootstrap``), more cases of strata by multinomial counts of their values in parts; no task holds either.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation
from .kept import kept

#: Units that are sent to tasks, some 50 bytes each.
UNITS = 1_000_000
#: Draws of a task, about.
DRAWS = 4_000_000
#: Distinct values of a stratum that one task draws, about.
PART = 50_000


def seed_of(base: int, *parts: str) -> int:
    """A seed of its own for every named statistic."""
    return base ^ int.from_bytes(hashlib.sha256(":".join(parts).encode()).digest()[:8], "big")


class Draws:
    """The numbers that ``random.Random(seed).randrange(n)`` gives, many at a time."""

    def __init__(self, seed: int):
        seed = abs(seed)
        words = [seed >> s & 0xFFFFFFFF for s in range(0, max(seed.bit_length(), 1), 32)]
        self.twister = np.random.RandomState(words)  # a list is seeded by array, as Python does
        self.raw = np.zeros(0, np.uint32)

    def below(self, n: int, size: int) -> np.ndarray:
        """``size`` numbers below n: the top bits of each 32-bit word, words that give n or more left out."""
        out, need = [], size
        shift = np.uint32(32 - n.bit_length())
        while need:
            if not len(self.raw):
                self.raw = self.twister.randint(0, 1 << 32, max(1024, min(2 * need, 1 << 20)), dtype=np.uint32)
            values = self.raw >> shift
            good = np.flatnonzero(values < n)[:need]
            used = len(values) if len(good) < need else good[-1] + 1
            out.append(values[good])
            need -= len(good)
            self.raw = self.raw[used:]
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def linear(ordered: np.ndarray, q: float) -> float:
    """Linear interpolation at (n - 1) q."""
    at = (len(ordered) - 1) * q
    low, high = math.floor(at), math.ceil(at)
    return float(ordered[low] if low == high else ordered[low] * (1 - (at - low)) + ordered[high] * (at - low))


def floored(ordered: np.ndarray, q: float) -> float:
    """The value at floor((n - 1) q)."""
    return float(ordered[min(len(ordered) - 1, max(0, math.floor(q * (len(ordered) - 1))))])


@dataclass(frozen=True)
class Metric:
    """A paired metric: columns of both sides, null where a case isn't eligible; how its cases make a value; which way is better.

    ``statistic`` is mean, ratio (the sides' sums over the sums of their ``of`` columns, 0 over nothing) or p95 (nearest rank).
    """

    name: str
    baseline: str
    candidate: str
    statistic: str = "mean"
    better: str = "higher"
    baseline_of: str | None = None
    candidate_of: str | None = None


def cluster_sums(rows: DataFrame, key: str, cluster: str, metrics: list[Metric]) -> DataFrame:
    """(key, cluster, metric, b, c, n): sums of every cluster's eligible cases."""
    each = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(m.baseline).cast("double").alias("x"), F.col(m.candidate).cast("double").alias("y")) for m in metrics)))
    long = rows.select(F.col(key).cast("string").alias("key"), F.col(cluster).cast("string").alias("cluster"), each.alias("m")).select("key", "cluster", "m.*").where("x is not null and y is not null")
    return long.groupBy("key", "cluster", "metric").agg(F.sum("x").alias("b"), F.sum("y").alias("c"), F.count("*").alias("n"))


def cluster_intervals(rows: DataFrame, key: str, cluster: str, metrics: list[Metric], samples: int, seed: int, level: float = 0.95, units: int = UNITS) -> DataFrame:
    """(key, metric, n, clusters, baseline, candidate, improvement, low, high): whole clusters drawn with replacement, as many as there are.

    Clusters are ordered by their name; each key and metric has a generator of its own, seeded by both. Below two clusters there is no interval.
    """
    per = kept(cluster_sums(rows, key, cluster, metrics))
    sizes = per.groupBy("key", "metric").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    mean = lambda c: (F.col(c) / F.col("n")).alias({"b": "baseline", "c": "candidate"}[c])
    whole = sizes.select("key", "metric", "n", "clusters", mean("b"), mean("c"), ((F.col("c") - F.col("b")) / F.col("n")).alias("improvement"))
    if per.count() > units:
        spread = per.select(F.concat_ws("\x1f", "key", "metric").alias("key"), F.col("cluster").alias("cluster_id"), F.col("b").alias("baseline"), F.col("c").alias("candidate"), "n")
        cut = evaluation.bootstrap(spread, "key", samples, seed, level, size="n").select(F.split("key", "\x1f")[0].alias("key"), F.split("key", "\x1f")[1].alias("metric"), "low", "high")
        return whole.join(cut, ["key", "metric"])
    held: dict[tuple[str, str], list] = {}
    for r in per.select("key", "metric", "cluster", (F.col("c") - F.col("b")).alias("d"), "n").collect():  # at most ``units`` rows
        held.setdefault((r.key, r.metric), []).append((r.cluster or "", r.d, r.n))
    tables = {k: np.array([(d, n) for _, d, n in sorted(v, key=lambda x: x[0])]) for k, v in held.items()}
    spark = rows.sparkSession
    told = spark.sparkContext.broadcast(tables)
    tasks = []
    for (name, metric), t in sorted(tables.items()):
        size = max(1, min(samples, DRAWS // max(1, len(t))))
        tasks += [(name, metric, first, min(samples, first + size)) for first in range(0, samples, size) if len(t) > 1]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, metric, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                table = told.value[name, metric]
                size = len(table)
                rng = Draws(seed_of(seed, name, metric))
                for _ in range(first):  # replicates of other tasks
                    rng.below(size, size)
                values = []
                for _ in range(first, last):
                    d, n = table[rng.below(size, size)].sum(0)
                    values.append(d / n)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([metric]), pa.array([values], pa.list_(pa.float64()))], names=["key", "metric", "values"])

    dealt = spark.createDataFrame(tasks, "key string, metric string, first int, last int").repartition(max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism)))
    drawn = dealt.mapInArrow(draw, "key string, metric string, values array<double>").groupBy("key", "metric").agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("v"))  # ``samples`` numbers

    def at(q: float):
        place = (samples - 1) * q
        low, high = math.floor(place), math.ceil(place)
        a, b = F.get("v", F.lit(low)), F.get("v", F.lit(high))
        return a if low == high else a * (1 - (place - low)) + b * (place - low)

    tail = (1 - level) / 2
    cut = drawn.select(F.col("key").alias("_k"), F.col("metric").alias("_m"), at(tail).alias("low"), at(1 - tail).alias("high"))
    return whole.join(cut, F.col("key").eqNullSafe(F.col("_k")) & (F.col("metric") == F.col("_m")), "left").drop("_k", "_m")


def statistic_of(kind: str, rows: np.ndarray) -> float:
    """Of rows (value, of)."""
    if kind == "p95":
        ordered = np.sort(rows[:, 0])
        return float(ordered[max(0, math.ceil(0.95 * len(ordered)) - 1)])
    total = rows[:, 1].sum() if kind == "ratio" else len(rows)
    return float(rows[:, 0].sum() / total) if total else 0.0


def stratified_intervals(rows: DataFrame, case: str, stratum: str, metrics: list[Metric], samples: int, seed: int, familywise: float = 0.05, target: float = 0.05, units: int = UNITS, part: int = PART) -> DataFrame:
    """(metric, n, baseline, candidate, improvement, low, high, target_low): cases drawn with replacement within their strata.

    Strata are taken in the order of their first case, cases by id. Improvements count the better way. The interval's level holds for all metrics together (each side at
    ``familywise`` over their number), target_low is at ``target`` of one metric; quantiles are at floor((samples - 1) q). One metric is one task's replicates.
    More than ``units`` cases of all metrics are drawn by ``counted_intervals``, in the same distribution.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), *(F.col(c).cast("double").alias(a) if c else F.lit(1.0).alias(a) for a, c in (("x", m.baseline), ("y", m.candidate), ("xo", m.baseline_of), ("yo", m.candidate_of)))) for m in metrics)))
    long = rows.select(F.col(case).alias("case"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), each.alias("m")).select("case", "stratum", "m.*").where("x is not null and y is not null")
    equal = kept(long.groupBy("metric", "stratum", "x", "y", "xo", "yo").agg(F.count("*").alias("c")))
    if (equal.agg(F.sum("c")).first()[0] or 0) > units:
        return counted_intervals(long, equal, metrics, samples, seed, familywise, target, part)
    held: dict[str, list] = {}
    for r in long.collect():  # at most ``units`` rows
        held.setdefault(r.metric, []).append((r.case, r.stratum, r.x, r.y, r.xo, r.yo))
    spark = rows.sparkSession
    told = spark.sparkContext.broadcast({k: sorted(v, key=lambda r: r[0]) for k, v in held.items()})
    kinds = {m.name: (m.statistic, 1.0 if m.better == "higher" else -1.0) for m in metrics}
    per_metric = familywise / len(metrics)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                cases = told.value[name]
                kind, sign = kinds[name]
                values = np.array([r[2:] for r in cases])
                strata: dict[str, list[int]] = {}
                for i, r in enumerate(cases):
                    strata.setdefault(r[1], []).append(i)
                groups = [np.array(g) for g in strata.values()]
                rng, deltas = Draws(seed_of(seed, name)), []
                for _ in range(samples):
                    picked = values[np.concatenate([g[rng.below(len(g), len(g))] for g in groups])]
                    deltas.append(sign * (statistic_of(kind, picked[:, [1, 3]]) - statistic_of(kind, picked[:, [0, 2]])))
                ordered = np.sort(deltas)
                left, right = statistic_of(kind, values[:, [0, 2]]), statistic_of(kind, values[:, [1, 3]])
                out = [len(cases), left, right, sign * (right - left), floored(ordered, per_metric), floored(ordered, 1 - per_metric), floored(ordered, target)]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out[0]], pa.int64()), *(pa.array([v], pa.float64()) for v in out[1:])], names=["metric", "n", "baseline", "candidate", "improvement", "low", "high", "target_low"])

    dealt = spark.createDataFrame([(m,) for m in sorted(held)], "metric string").repartition(max(1, len(held)))
    return dealt.mapInArrow(draw, "metric string, n long, baseline double, candidate double, improvement double, low double, high double, target_low double")


def counted_intervals(long: DataFrame, equal: DataFrame, metrics: list[Metric], samples: int, seed: int, familywise: float, target: float, part: int) -> DataFrame:
    """``stratified_intervals`` of any number of cases, from ``long`` (metric, stratum, x, y, xo, yo) and its counts ``equal`` (with c).

    Cases of equal values are interchangeable, so that drawing a stratum's cases with replacement is drawing the multinomial counts of its distinct values. These
    are dealt by hash to parts of about ``part`` values: each task draws its part's total of every sample (the same numbers in all tasks of the stratum) and
    divides it among its values. Sums are added up by Spark. For a percentile only what is drawn near it is listed, what lies below is
    counted; where the rank falls outside in a sample, all is drawn again with a wider range, so that the percentile is exact.
    """
    spark = long.sparkSession
    strata = equal.groupBy("metric", "stratum").agg(F.ceil(F.count("*") / part).alias("parts"))
    dealt = kept(equal.join(strata, ["metric", "stratum"]).withColumn("part", F.pmod(F.xxhash64("x", "y", "xo", "yo"), "parts")).drop("parts"))
    sizes: dict[tuple[str, str], dict[int, int]] = {}
    for r in dealt.groupBy("metric", "stratum", "part").agg(F.sum("c").alias("n")).orderBy("metric", "stratum", "part").collect():  # a row a part
        sizes.setdefault((r.metric, r.stratum), {})[r.part] = r.n
    counts = {m: sum(sum(v.values()) for k, v in sizes.items() if k[0] == m) for m in {k[0] for k in sizes}}
    told = spark.sparkContext.broadcast(sizes)
    kinds = {m.name: m.statistic for m in metrics}

    def sampled(ranges: dict[str, dict[str, tuple[float, float]]]):
        def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            metric, stratum, mine = key
            pdf = pdf.sort_values(["x", "y", "xo", "yo"])
            parts = told.value[metric, stratum]
            n, c = np.array(list(parts.values())), pdf["c"].to_numpy()
            of_stratum = np.random.default_rng(seed_of(seed, metric, stratum) & (1 << 128) - 1)
            totals = of_stratum.multinomial(n.sum(), n / n.sum(), samples)[:, list(parts).index(mine)]
            rng = np.random.default_rng(seed_of(seed, metric, stratum, str(mine)) & (1 << 128) - 1)
            out, size = [], max(1, DRAWS // len(c))
            for first in range(-1, samples, size):  # sample -1 is the cases themselves
                last = min(samples, first + size)
                w = rng.multinomial(totals[max(first, 0) : last], c / c.sum())
                w = np.vstack([c[None, :], w]) if first < 0 else w
                names = np.arange(first, last)
                for side, of in (("x", "xo"), ("y", "yo")):
                    v = pdf[side].to_numpy()
                    if metric not in ranges:
                        out.append(pd.DataFrame({"sample": names, "side": side, "value": w @ v, "w": w @ pdf[of].to_numpy()}))
                        continue
                    low, high = ranges[metric][side]
                    out.append(pd.DataFrame({"sample": names, "side": side, "value": -np.inf, "w": w[:, v < low].sum(1).astype(float)}))
                    near = (v >= low) & (v <= high)
                    at, which = np.nonzero(w[:, near])
                    out.append(pd.DataFrame({"sample": names[at], "side": side, "value": v[near][which], "w": w[:, near][at, which].astype(float)}))
            return pd.concat(out).assign(metric=metric)[["metric", "sample", "side", "value", "w"]]

        return draw

    def drawn(of: list[str], ranges: dict) -> DataFrame:
        return dealt.where(F.col("metric").isin(of)).groupBy("metric", "stratum", "part").applyInPandas(sampled(ranges), "metric string, sample int, side string, value double, w double")

    sums, places = [m for m in counts if kinds[m] != "p95"], [m for m in counts if kinds[m] == "p95"]
    ratio = F.when(F.sum("w") != 0, F.sum("value") / F.sum("w")).otherwise(0.0)
    found = drawn(sums, {}).groupBy("metric", "sample", "side").agg(ratio.alias("v"))
    width = 1.0
    while places:
        ranges = {}
        for m in places:
            near = width * (8 * math.sqrt(0.0475 / counts[m]) + 2e-4)  # 8 deviations of the rank, and what the approximate quantile may be off
            low, high = max(0.0, 0.95 - near), min(1.0, 0.95 + near)
            got = long.where(F.col("metric") == m).agg(*(F.percentile_approx(c, [low, high], 10_000).alias(c) for c in "xy")).first()
            ranges[m] = {c: (got[c][0] if low > 0 else -math.inf, got[c][1] if high < 1 else math.inf) for c in "xy"}
        listed = drawn(places, ranges).groupBy("metric", "sample", "side", "value").agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("metric", "sample", "side").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rank = F.create_map(*(F.lit(x) for m in places for x in (m, float(max(1, math.ceil(0.95 * counts[m]))))))
        here = kept(listed.withColumn("upto", upto).groupBy("metric", "sample", "side").agg(F.min(F.when(F.col("upto") >= rank[F.col("metric")], F.col("value"))).alias("v")))
        if here.where(F.col("v").isNull() | (F.col("v") == -math.inf)).limit(1).count() == 0:
            found = found.unionByName(here)
            break
        width *= 4
    sign = F.create_map(*(F.lit(x) for m in metrics for x in (m.name, 1.0 if m.better == "higher" else -1.0)))[F.col("metric")]
    sided = found.groupBy("metric", "sample").agg(F.max(F.when(F.col("side") == "x", F.col("v"))).alias("baseline"), F.max(F.when(F.col("side") == "y", F.col("v"))).alias("candidate")).withColumn("delta", sign * (F.col("candidate") - F.col("baseline")))
    own = lambda c: F.max(F.when(F.col("sample") < 0, F.col(c))).alias("improvement" if c == "delta" else c)
    ordered = F.sort_array(F.collect_list(F.when(F.col("sample") >= 0, F.col("delta"))))  # ``samples`` numbers
    at = lambda q: F.get("ordered", F.lit(min(samples - 1, max(0, math.floor(q * (samples - 1))))))
    per_metric = familywise / len(metrics)
    n = F.create_map(*(F.lit(x) for m in counts.items() for x in m))[F.col("metric")].cast("long")
    whole = sided.groupBy("metric").agg(own("baseline"), own("candidate"), own("delta"), ordered.alias("ordered"))
    return whole.select("metric", n.alias("n"), "baseline", "candidate", "improvement", at(per_metric).alias("low"), at(1 - per_metric).alias("high"), at(target).alias("target_low"))


def hierarchical_intervals(rows: DataFrame, key: str, cluster: str, case: str, metric: Metric, samples: int, seed: int, level: float = 0.95) -> DataFrame:
    """(key, metric, n, clusters, baseline, candidate, improvement, low, high) where a case has several measurements: their mean is the case's, and whole clusters of cases are drawn."""
    per = rows.groupBy(key, cluster, case).agg(F.avg(metric.baseline).alias(metric.baseline), F.avg(metric.candidate).alias(metric.candidate))
    return cluster_intervals(per, key, cluster, [metric], samples, seed, level)
