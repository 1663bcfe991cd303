"""Decisions on a candidate from paired cases: intervals of metrics, slices, load and operations, each rule with its code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import slice_decisions
from .kept import kept
from .resampling import Metric, cluster_intervals, stratified_intervals


@dataclass(frozen=True)
class RetrievalPolicy:
    """Limits of the retrieval gate."""

    metrics: tuple[Metric, ...]
    languages: tuple[str, ...]
    contents: tuple[str, ...]
    scopes: tuple[str, ...]
    samples: int = 20_000
    seed: int = 20260713
    level: float = 0.95
    global_regression: float = 0.01
    slice_regression: float = 0.05
    target_gains: dict[str, float] = field(default_factory=dict)
    load_concurrency: int = 10
    load_requests: int = 200
    p95_ratio: float = 1.1
    p95_increase_ms: float = 250.0
    throughput_ratio: float = 0.9
    operation_seconds: float = 60.0
    determinism_replays: int = 3


def retrieval_decisions(cases: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """(kind, slice_id, metric, n, clusters, baseline, candidate, improvement, low, high, margin, target, passed, code): the whole, every required language, content and scope, and abstention.

    ``cases`` are (cluster_id, language, contents, scope, answerable, baseline_abstained, candidate_abstained) and the metrics' columns. A metric passes
    where its interval's lower end is at most the margin below 0, and reaches the target gain if the whole has one. A required slice
    without two clusters of eligible cases does not pass. ``code`` is the failure's, null for a pass.
    """
    keys = F.array(
        F.lit("global"),
        F.concat(F.lit("language:"), "language"),
        F.concat(F.lit("scope:"), "scope"),
    )
    keys = F.array_compact(F.concat(keys, F.transform(F.coalesce("contents", F.array().cast("array<string>")), lambda c: F.concat(F.lit("content:"), c))))
    yes = cases.where("answerable").withColumn("_key", F.explode(F.array_distinct(keys)))
    found = cluster_intervals(yes, "_key", "cluster_id", list(policy.metrics), policy.samples, policy.seed, policy.level)
    abstained = Metric("abstention_rate", "baseline_abstained", "candidate_abstained")
    sided = cases.where("not answerable").withColumns({"_key": F.lit("no_answer"), "baseline_abstained": F.col("baseline_abstained").cast("double"), "candidate_abstained": F.col("candidate_abstained").cast("double")})
    found = found.unionByName(cluster_intervals(sided, "_key", "cluster_id", [abstained], policy.samples, policy.seed, policy.level))
    names = [m.name for m in policy.metrics]
    required = [("global", "global", m) for m in names] + [(f"{kind}:{v}", kind, m) for kind, vs in (("language", policy.languages), ("content", policy.contents), ("scope", policy.scopes)) for v in vs for m in names]
    required.append(("no_answer", "no_answer", abstained.name))
    wanted = cases.sparkSession.createDataFrame(required, "key string, kind string, metric string")
    rows = wanted.join(found, ["key", "metric"], "left")
    margin = F.when(F.col("kind").isin("global", "no_answer"), policy.global_regression).otherwise(policy.slice_regression)
    gains = F.create_map(*(F.lit(x) for kv in policy.target_gains.items() for x in kv)) if policy.target_gains else F.lit(None).cast("map<string,double>")
    target = F.when(F.col("kind") == "global", F.element_at(gains, F.col("metric")))
    rows = rows.withColumns({"margin": margin, "target": target})
    holds = F.coalesce(F.col("low") >= -F.col("margin"), F.lit(False))
    gained = F.col("target").isNull() | F.coalesce(F.col("low") >= F.col("target"), F.lit(False))
    slice_id = F.when(F.col("key").contains(":"), F.substring_index("key", ":", -1)).otherwise(F.lit(""))
    few = F.col("low").isNull()
    code = F.when(few, F.concat(F.lit("slice_insufficient:"), "key", F.lit(":"), "metric")).when(F.col("kind") == "no_answer", F.when(~holds, F.lit("no_answer_abstention_regression")))
    code = code.when((F.col("kind") == "global") & ~holds, F.concat(F.lit("global_regression:"), "metric")).when(~gained, F.concat(F.lit("target_gain:"), "metric"))
    code = code.when((F.col("kind") != "global") & ~holds, F.concat(F.lit("slice_regression:"), "key", F.lit(":"), "metric"))
    # A whole metric may fail both its margin and its target.
    second = F.when(~few & (F.col("kind") == "global") & ~holds & ~gained, F.concat(F.lit("target_gain:"), "metric"))
    return rows.select("kind", slice_id.alias("slice_id"), "metric", "n", "clusters", "baseline", "candidate", "improvement", "low", "high", "margin", "target", (holds & gained).alias("passed"), F.array_compact(F.array(code, second)).alias("codes"))


def load_codes(load: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """(codes) of one row of both sides' concurrency, requests, errors, p95 and throughput (prefix b_ or c_)."""
    sound = F.lit(True)
    for side in "bc":
        sound &= (F.col(f"{side}_concurrency") >= policy.load_concurrency) & (F.col(f"{side}_requests") >= policy.load_requests) & (F.col(f"{side}_errors") == 0)
    most = F.least(F.col("b_p95") * policy.p95_ratio, F.col("b_p95") + policy.p95_increase_ms)
    rules = {"load_integrity": sound, "latency_p95": F.col("c_p95") <= most, "throughput": F.col("c_throughput") / F.col("b_throughput") >= policy.throughput_ratio}
    return load.select(failed(rules).alias("codes"))


def operation_codes(operations: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """(codes) of one row: leaks of both sides, <check>_ok and <check>_seconds of the four timed checks, replays, and whether a rollback restores the baseline's index."""
    rules = {"rls_leak:baseline": F.col("b_leaks") == 0, "rls_leak:candidate": F.col("c_leaks") == 0}
    rules |= {name: F.col(f"{name}_ok") & (F.col(f"{name}_seconds") <= policy.operation_seconds) for name in ("update_visibility", "delete_visibility", "restart_recovery", "rollback")}
    rules["determinism"] = (F.col("replays") >= policy.determinism_replays) & (F.col("mismatches") == 0) & (F.col("replay_seconds") <= policy.operation_seconds)
    rules["rollback_binding"] = F.col("rollback_manifest") == F.col("baseline_manifest")
    return operations.select(failed(rules).alias("codes"))


def failed(rules: dict):
    """The names of the rules that don't hold, or have no value."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))


def decision(*codes: DataFrame) -> DataFrame:
    """One row (failure_codes, sorted and distinct; accepted) from frames of ``codes``."""
    rows = codes[0].select("codes")
    for more in codes[1:]:
        rows = rows.unionByName(more.select("codes"))
    found = rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("failure_codes"))
    return found.withColumn("accepted", F.size("failure_codes") == 0)


def retrieval_gate(cases: DataFrame, load: DataFrame, operations: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """The retrieval gate: every metric and slice by its interval, load and operations by their limits."""
    return decision(retrieval_decisions(cases, policy), load_codes(load, policy), operation_codes(operations, policy))


@dataclass(frozen=True)
class ReleaseMetric:
    """A metric of the release gate with its margins, bounds and, if it is the target, the gain that counts."""

    metric: Metric
    margin: float
    relative_margin: float | None = None
    minimum: float | None = None
    maximum: float | None = None
    practical: float = 0.0


@dataclass(frozen=True)
class ReleasePolicy:
    metrics: tuple[ReleaseMetric, ...]
    target: str
    samples: int = 10_000
    seed: int = 20260713
    familywise: float = 0.05
    target_alpha: float = 0.05
    language_margin: float = 0.03
    content_margin: float = 0.05
    enough: int = 20


def release_metrics(cases: DataFrame, policy: ReleasePolicy) -> DataFrame:
    """(metric, n, baseline, candidate, improvement, low, high, margin, target_low, passed, codes): every metric against its margin, its bounds and, for the target, its gain."""
    found = stratified_intervals(cases, "case_id", "stratum", [m.metric for m in policy.metrics], policy.samples, policy.seed, policy.familywise, policy.target_alpha)
    limits = [(m.metric.name, m.margin, m.relative_margin, m.minimum, m.maximum, m.practical, m.metric.name == policy.target) for m in policy.metrics]
    rows = cases.sparkSession.createDataFrame(limits, "metric string, absolute double, relative double, minimum double, maximum double, practical double, target boolean").join(found, "metric", "left")
    rows = rows.withColumn("margin", F.least("absolute", F.abs("baseline") * F.col("relative")))
    rules = {
        "noninferiority": F.col("low") >= -F.col("margin"),
        "bound": F.coalesce(F.col("candidate") >= F.col("minimum"), F.col("minimum").isNull()) & F.coalesce(F.col("candidate") <= F.col("maximum"), F.col("maximum").isNull()),
        "practical_gain": ~F.col("target") | (F.col("improvement") >= F.col("practical")),
        "statistical_gain": ~F.col("target") | (F.col("target_low") > 0),
    }
    codes = F.when(F.col("n").isNull(), F.array(F.lit("no_cases"))).otherwise(failed(rules))
    codes = F.transform(codes, lambda c: F.concat(c, F.lit(":"), F.col("metric")))
    return rows.withColumn("codes", codes).select("metric", "n", "baseline", "candidate", "improvement", "low", "high", "margin", "target_low", (F.size("codes") == 0).alias("passed"), "codes")


def release_slices(cases: DataFrame, metrics: dict[str, tuple[str, str]], policy: ReleasePolicy) -> DataFrame:
    """(dimension, value, metric, n, baseline, candidate, minimum, passed): languages, hops of answerable cases, contents, answerability by language, strict refusal of leakage cases.

    ``cases`` have language, hop, contents, answerable, leakage, and baseline_/candidate_ of correct (answerability) and refused (a strict refusal).
    """
    measured = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(b).cast("double").alias("baseline"), F.col(c).cast("double").alias("candidate")) for m, (b, c) in metrics.items()))
    place = F.concat(F.array(F.struct(F.lit("language").alias("dimension"), F.col("language").alias("value"))), F.transform(F.array_compact(F.array(F.when(F.col("answerable"), F.col("hop")))), lambda h: F.struct(F.lit("hop_type").alias("dimension"), h.alias("value"))))
    content = F.transform("contents", lambda c: F.struct(F.lit("content_type").alias("dimension"), c.alias("value")))
    flat = lambda df, places: df.select(F.explode(places).alias("p"), "m").select("p.*", "m.*")
    rows = cases.withColumn("m", F.explode(measured))
    answer = F.struct(F.lit("answerability_accuracy").alias("metric"), F.col("baseline_correct").cast("double").alias("baseline"), F.col("candidate_correct").cast("double").alias("candidate"))
    refusal = F.struct(F.lit("strict_abstention").alias("metric"), F.col("baseline_refused").cast("double").alias("baseline"), F.col("candidate_refused").cast("double").alias("candidate"))
    leak = F.array(F.struct(F.lit("leakage").alias("dimension"), F.lit("policy_refusal").alias("value")))
    language = F.array(F.struct(F.lit("language").alias("dimension"), F.col("language").alias("value")))
    near = slice_decisions(flat(rows, place).unionByName(flat(cases.where("leakage").withColumn("m", refusal), leak)), policy.language_margin, policy.enough)
    far = slice_decisions(flat(rows, content), policy.content_margin, policy.enough)
    always = slice_decisions(flat(cases.withColumn("m", answer), language), policy.language_margin, 1)
    return near.unionByName(far).unionByName(always)


def release_gate(cases: DataFrame, metrics: dict[str, tuple[str, str]], qualification: DataFrame, policy: ReleasePolicy) -> DataFrame:
    """One row (failure_codes, accepted): metrics by their intervals, slices, leakage there at all, and the checks (name, ok) of ``qualification``, a check without a value failing."""
    cases = kept(cases)
    slices = release_slices(cases, metrics, policy)
    bad = slices.where(~F.coalesce("passed", F.lit(False))).select(F.array(F.concat_ws(":", F.lit("slice"), "dimension", "value", "metric")).alias("codes"))
    none = cases.agg(F.count_if(F.col("leakage")).alias("n")).select(F.when(F.col("n") == 0, F.array(F.lit("no_leakage_cases"))).otherwise(F.array().cast("array<string>")).alias("codes"))
    checks = qualification.where(~F.coalesce("ok", F.lit(False))).select(F.array(F.concat("name", F.lit("_gate_failed"))).alias("codes"))
    return decision(release_metrics(cases, policy), bad, none, checks)
