"""Queries: intervals by resampling, gates that rest on them, and the split that shares no document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, resampling, splits
from ..operators.resampling import Metric
from .pools import cases
from .registry import query, table

RECALL, NDCG = Metric("recall_at_10", "baseline", "candidate"), Metric("ndcg_at_10", "b_ndcg", "c_ndcg")
LATENCY = Metric("latency_p95_ms", "b_latency", "c_latency", "p95", "lower")
NUMBERS = Metric("unsupported_number_rate", "b_bad", "c_bad", "ratio", "lower", "b_numbers", "c_numbers")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as paired cases, users their clusters."""
    e = F.col("case_id")
    scaled = lambda k, m, d: (e * k % m) / d
    return cases(spark, sf_dir).select(
        "case_id", "cluster_id", "pool", F.col("lang").alias("language"), "answerable", "baseline", "candidate", scaled(5, 11, 10.0).alias("b_ndcg"), (F.least((e * 5 % 11) + (e % 3 == 0).cast("int"), F.lit(10)) / 10.0).alias("c_ndcg"),
        F.col("latency").alias("b_latency"), (F.col("latency") * (0.8 + (e % 5) / 10.0)).alias("c_latency"), (e % 4).alias("b_numbers"), (e % 3).alias("c_numbers"), F.least(e % 2, e % 4).alias("b_bad"), F.least(e % 2, e % 3).alias("c_bad"),
        F.array(F.when(e % 2 == 0, "text").otherwise("table"), F.when(e % 5 == 0, "image").otherwise("text")).alias("contents"), F.concat(F.lit("s"), (F.col("cluster_id") % 4).cast("string")).alias("scope"), F.col("pool").alias("hop"), (e % 40 == 0).alias("leakage"),
        (e % 6 != 0).alias("baseline_abstained"), (e % 7 != 0).alias("candidate_abstained"), (e % 13 != 0).alias("baseline_correct"), (e % 17 != 0).alias("candidate_correct"), F.lit(True).alias("baseline_refused"), (e % 400 != 0).alias("candidate_refused"),
        F.concat_ws(":", "lang", F.when(F.col("answerable"), F.col("pool")).otherwise("no_answer")).alias("stratum"),
    )


@query("sta1_cluster_draws")
def sta1_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of two metrics in every pool, whole users drawn."""
    rows = paired(spark, sf_dir)
    return resampling.cluster_intervals(rows, "pool", "cluster_id", [RECALL, NDCG], 1000, 7)


@query("sta2_stratified_draws")
def sta2_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that hold for four metrics together: a mean, another, a ratio of sums and a percentile; cases drawn within language and hop."""
    return resampling.stratified_intervals(paired(spark, sf_dir), "case_id", "stratum", [RECALL, NDCG, LATENCY, NUMBERS], 200, 7)


@query("sta3_hierarchical_draws")
def sta3_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements (events) of a case (a user in a pool) count as their mean; clusters are users' last digits."""
    rows = paired(spark, sf_dir).withColumn("digit", F.col("cluster_id") % 50)
    return resampling.hierarchical_intervals(rows, "language", "digit", "cluster_id", RECALL, 1000, 7)


def retrieval_policy(samples: int = 500) -> gates.RetrievalPolicy:
    return gates.RetrievalPolicy((RECALL, NDCG), ("ru", "en", "zh"), ("text", "table", "image"), ("s0", "s1", "s2", "s3", "s9"), samples, 7, target_gains={"ndcg_at_10": 0.02}, slice_regression=0.02)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two load runs from the events: the even seconds' and the odd seconds'."""
    side = F.second("ts") % 2 == 0
    rows = table(spark, sf_dir, "events")
    both = {}
    for name, mine in (("b", side), ("c", ~side)):
        both |= {f"{name}_concurrency": F.lit(10), f"{name}_requests": F.count_if(mine), f"{name}_errors": F.lit(0), f"{name}_p95": F.percentile_approx(F.when(mine, F.col("value")), 0.95, 10_000), f"{name}_throughput": F.count_if(mine).cast("double")}
    return rows.agg(*(c.alias(n) for n, c in both.items()))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational checks, their times taken from the events."""
    value = lambda kind: F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))
    checks = ("update_visibility", "delete_visibility", "restart_recovery", "rollback")
    kinds = ("click", "view", "purchase", "signup")
    columns = {f"{c}_ok": F.lit(True) for c in checks} | {f"{c}_seconds": value(k) for c, k in zip(checks, kinds)}
    columns |= {"b_leaks": F.count_if(F.col("user_id").isNull()), "c_leaks": F.count_if(F.col("user_id") < 0), "replays": F.lit(3), "mismatches": F.lit(0), "replay_seconds": F.lit(1.0), "rollback_manifest": F.lit("a"), "baseline_manifest": F.lit("a")}
    return table(spark, sf_dir, "events").agg(*(c.alias(n) for n, c in columns.items()))


@query("gat1_retrieval_decisions")
def gat1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric in the whole, in languages, contents and scopes (one of which has no case), and abstention."""
    return gates.retrieval_decisions(paired(spark, sf_dir), retrieval_policy())


@query("gat1_retrieval_gate")
def gat1_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on all of it."""
    return gates.retrieval_gate(paired(spark, sf_dir), load(spark, sf_dir), operations(spark, sf_dir), retrieval_policy())


def release_policy() -> gates.ReleasePolicy:
    metrics = (gates.ReleaseMetric(RECALL, 0.02, 0.05), gates.ReleaseMetric(NDCG, 0.01, practical=0.02), gates.ReleaseMetric(LATENCY, 50.0, 0.1, maximum=1000.0), gates.ReleaseMetric(NUMBERS, 0.01, maximum=0.5))
    return gates.ReleasePolicy(metrics, "ndcg_at_10", 200, 7)


@query("gat2_release_metrics")
def gat2_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.release_metrics(paired(spark, sf_dir), release_policy())


@query("gat2_release_decision")
def gat2_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, slices and checks of a release (a check is an event type, held by a mean below 60)."""
    checks = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg((F.avg("value") < 60).alias("ok"))
    return gates.release_gate(paired(spark, sf_dir), {"recall_at_10": ("baseline", "candidate"), "ndcg_at_10": ("b_ndcg", "c_ndcg")}, checks, release_policy())


SPLIT = """WITH s AS (SELECT o_custkey AS cluster, count(*) AS size, list(DISTINCT o_orderpriority) AS have FROM orders GROUP BY 1),
t AS (SELECT count(*) AS n, sum(size) AS total, greatest(1, least(round_even(sum(size) * 0.3, 0), sum(size) - 1)) AS wanted FROM s),
l AS (SELECT label, count(*) AS n FROM (SELECT unnest(have) AS label FROM s) GROUP BY 1),
p AS (SELECT cluster, sha256('7:' || least_case) AS h, size, have, least_case FROM (SELECT s.*, c.least_case FROM s JOIN (SELECT o_custkey AS cluster, min(o_orderkey) AS least_case FROM orders GROUP BY 1) c USING (cluster))),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS chosen, sum(size) OVER (ORDER BY h) AS upto FROM p),
x AS (SELECT r.h, r.chosen, r.upto, l.label, l.n, count(*) FILTER (WHERE list_contains(r.have, l.label)) OVER (PARTITION BY l.label ORDER BY r.h) AS here FROM r, l),
k AS (SELECT h, chosen, upto, round(sum(abs(here / chosen - x.n / t.n)), 9) AS error, abs(any_value(upto) - any_value(wanted)) AS off FROM x, t WHERE chosen < t.n GROUP BY 1, 2, 3 HAVING bool_and(x.n < 2 OR (here > 0 AND here < x.n))),
b AS (SELECT chosen FROM k ORDER BY off, error, h LIMIT 1)
SELECT o.o_orderkey AS "case", r.least_case AS cluster, CASE WHEN r.chosen <= (SELECT chosen FROM b) THEN 'locked' ELSE 'tuning' END AS part FROM orders o JOIN r ON r.cluster = o.o_custkey"""


@query("sta6_cluster_split", SPLIT)
def sta6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders split by customers, 30 % locked, every priority on both sides."""
    rows = table(spark, sf_dir, "orders")
    of = rows.select(F.col("o_orderkey").alias("case"), F.col("o_custkey").alias("document"))
    return splits.cluster_split(of, rows.select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("label")), 7, 0.3)
