"""Decisions by rules alone: a shadow candidate by its slices, a structure gate by its evidence, an answer by its checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities
from ..sources.gold import text_hashes
from .gates import failed
from .kept import kept

#: Differences below are noise of addition.
NOISE = 1e-12


@dataclass(frozen=True)
class ShadowPolicy:
    """Metrics that must hold in the whole, in slices, and as absolute values of the baseline."""

    whole: tuple[str, ...] = ("recall_at_5", "ndcg_at_10", "evidence_coverage", "page_coverage")
    sliced: tuple[str, ...] = ("recall_at_5", "ndcg_at_10")
    absolute: tuple[str, ...] = ("recall_at_10", "evidence_coverage")
    floor: float = 0.5
    regression: float = 0.01
    enough: int = 1


def shadow_means(cases: DataFrame, dimensions: list[str], policy: ShadowPolicy) -> DataFrame:
    """(cohort, dimension, value, n, b_<metric>, c_<metric>): means of the answerable, of the probes without an answer, and of every slice of the answerable.

    ``cases`` have ``answerable``, the dimensions (a value or an array of them) and b_ and c_ of every metric. One aggregate over all
    groups, partial before its shuffle.
    """
    metrics = dict.fromkeys(policy.whole + policy.sliced + policy.absolute)
    types = dict(cases.dtypes)
    place = lambda c, d, v: F.struct(F.lit(c).alias("cohort"), F.lit(d).alias("dimension"), v.alias("value"))
    whole = F.array(F.when(F.col("answerable"), place("answerable", None, F.lit(None).cast("string"))).otherwise(place("no_answer_probe", None, F.lit(None).cast("string"))))
    none = F.array().cast("array<struct<cohort:string,dimension:string,value:string>>")

    def placed(d: str) -> Column:
        values = F.array_distinct(F.col(d)) if types[d].startswith("array") else F.array(F.col(d))
        values = F.array_compact(F.transform(values, lambda v: v.cast("string")))
        return F.when(F.col("answerable"), F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: place("slice", d, v))).otherwise(none)

    rows = cases.withColumn("p", F.explode(F.concat(whole, *map(placed, dimensions))))
    means = [F.avg(F.col(f"{s}_{m}").cast("double")).alias(f"{s}_{m}") for m in metrics for s in "bc"]
    return rows.groupBy("p").agg(F.count("*").alias("n"), *means).select("p.*", "n", *(f"{s}_{m}" for m in metrics for s in "bc"))


def shadow_decision(cases: DataFrame, dimensions: list[str], policy: ShadowPolicy = ShadowPolicy()) -> DataFrame:
    """One row (accepted, improved, failure_codes, checked_slices, rare_slices).

    A mean more than ``regression`` below the baseline's rejects, in the whole, among the probes and in every slice of enough cases; so do a
    baseline below the floor, a slice of too few cases and a cohort without any. A slice of at most a tenth of the answerable cases (or five) is rare. A missing mean fails its rule.
    """
    means = kept(shadow_means(cases, dimensions, policy))
    held = lambda m: F.col(f"c_{m}") - F.col(f"b_{m}") >= -policy.regression - NOISE
    codes = []
    for cohort, name in (("answerable", "overall"), ("no_answer_probe", "no_answer_probe")):
        rules = {f"baseline_below_floor:{cohort}:{m}": F.col(f"b_{m}") >= policy.floor for m in policy.absolute} | {f"{name}_regression:{m}": held(m) for m in policy.whole}
        codes.append(F.when(F.col("cohort") == cohort, failed(rules)))
    where = F.concat_ws(":", "dimension", "value")
    lost = F.transform(failed({m: held(m) for m in policy.sliced}), lambda m: F.concat(F.lit("slice_regression:"), where, F.lit(":"), m))
    codes.append(F.when(F.col("n") < policy.enough, F.array(F.concat(F.lit("insufficient_slice:"), where))).otherwise(lost))
    gained = F.lit(False)
    for m in policy.sliced:
        gained |= F.col(f"c_{m}") - F.col(f"b_{m}") > NOISE
    answerable = means.where("cohort = 'answerable'").agg(F.coalesce(F.max("n"), F.lit(0)).alias("of"))  # one row
    checked = (F.col("cohort") == "slice") & (F.col("n") >= policy.enough)
    rare = checked & (F.col("n") <= F.greatest(F.lit(5), F.ceil(F.col("of") * 0.1)))
    total = means.join(F.broadcast(answerable), how="left").withColumn("codes", F.coalesce(*codes)).agg(
        F.flatten(F.collect_list("codes")).alias("codes"), F.coalesce(F.bool_or((F.col("cohort") == "answerable") & gained), F.lit(False)).alias("improved"),
        F.count_if(checked).alias("checked_slices"), F.count_if(rare).alias("rare_slices"), F.count_if(F.col("cohort") == "answerable").alias("yes"), F.count_if(F.col("cohort") == "no_answer_probe").alias("no"),
    )
    none = failed({"no_cases:answerable": F.col("yes") > 0, "no_cases:no_answer_probe": F.col("no") > 0})
    found = F.array_sort(F.concat("codes", none))
    return total.select((F.size(found) == 0).alias("accepted"), "improved", found.alias("failure_codes"), "checked_slices", "rare_slices")


#: How an answer says that it has none.
ABSTENTIONS = (
    "недостаточно данных", "недостаточно информации", "нет достаточной информации", "в документах нет", "insufficient data", "insufficient evidence", "insufficient information",
    "not enough information", "the documents do not contain", "没有足够的信息", "没有足够资料", "信息不足", "资料不足", "文档中没有",
)


def abstains(answer: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)\s+", " "))
    out = F.lit(False)
    for marker in ABSTENTIONS:
        out |= plain.contains(marker)
    return out


def answer_checks(cases: DataFrame) -> DataFrame:
    """(case_id, failures, passed): an answer's deterministic checks; each failure's code once, sorted.

    ``cases`` have case_id, scope_id, answerable, answer, gold_review (the mode), and of the case, its sidecar and the candidate ``bindings`` (array of
    structs that must be equal); ``retrieved`` (chunk_id, document_id, document_ref), ``chunks`` (chunk_id, document_id, text) as stored, ``exact`` (chunk_id,
    quote, content_sha256, text_sha256), ``probe`` (chunk_id, content_sha256), ``cited`` chunk ids, the gold ``document_refs``, ``owners`` of the chunks, and
    the quantities ``expected`` and ``supported`` (value, unit). Arrays are one answer's, some dozens; null arrays count as empty.
    """
    plain = cases
    for name, kind in cases.dtypes:
        if kind.startswith("array"):
            plain = plain.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    plain = plain.withColumns({"quote_hashes": text_hashes(F.transform("exact", lambda e: e["quote"])), "chunk_hashes": text_hashes(F.transform("chunks", lambda c: c["text"]))})
    ids = lambda name: F.array_sort(F.array_distinct(F.transform(name, lambda x: x["chunk_id"])))
    stored = F.arrays_zip("chunks", "chunk_hashes")
    same = lambda a, b: F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) == 0
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    consistent = F.forall("retrieved", lambda r: F.exists("chunks", lambda c: (c["chunk_id"] == r["chunk_id"]) & (c["document_id"] == r["document_id"])))
    wanted = F.when(F.col("gold_review"), F.array_union(ids("exact"), ids("probe"))).otherwise(ids("probe"))
    quoted = F.forall(F.arrays_zip("exact", "quote_hashes"), lambda e: (e["quote_hashes"] == e["exact"]["content_sha256"]) & F.exists("chunks", lambda c: (c["chunk_id"] == e["exact"]["chunk_id"]) & c["text"].contains(e["exact"]["quote"]) & (F.sha2(c["text"], 256) == e["exact"]["text_sha256"])))
    probed = F.forall("probe", lambda p: F.exists(stored, lambda c: (c["chunks"]["chunk_id"] == p["chunk_id"]) & (c["chunk_hashes"] == p["content_sha256"])))
    scopes = F.array_distinct(F.transform("owners", lambda o: F.concat(F.lit("scope-sha256:"), F.sha2(o, 256))))
    said = quantities.mentions(F.col("answer"))
    evidence = F.flatten(F.transform("exact", lambda e: F.transform(quantities.mentions(e["quote"]), lambda m: m["value"])))
    pair = lambda of: F.transform(of, lambda q: F.concat_ws("|", q["value"], q["unit"]))
    pairs = pair(F.filter(said, lambda m: m["unit"].isNotNull() & (m["unit"] != "")))
    rules = {
        "gold_binding": F.size(F.array_distinct("bindings")) == 1,
        "retrieval_snapshot": same(ids("retrieved"), ids("chunks")) & consistent & same(ids("retrieved"), wanted),
        "scope": (F.size(scopes) == 1) & (scopes[0] == F.col("scope_id")) & within(F.transform("retrieved", lambda r: r["document_ref"]), F.col("document_refs")),
        "exact_quote": quoted & probed,
        "evidence_coverage": F.when(F.col("answerable"), within(ids("exact"), F.col("cited"))).otherwise(F.size("cited") == 0),
        "answerability": abstains(F.col("answer")) != F.col("answerable"),
        "number_unit": within(F.transform(said, lambda m: m["value"]), evidence) & within(pair("expected"), pairs) & within(pairs, pair("supported")) & (F.col("answerable") | (F.size(said) == 0)),
    }
    failures = F.array_sort(failed(rules))
    return plain.select("case_id", failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


TASKS = ("text_continuation", "table_continuation", "image_association")


@dataclass(frozen=True)
class StructurePolicy:
    """The evidence that a structure gate needs in each language, and how much may be lost."""

    languages: tuple[str, ...] = ("ru", "en", "zh")
    documents: int = 1
    pages: int = 5
    heading_edges: int = 10
    order_pairs: int = 20
    relations: int = 10
    relations_per_language: int = 3
    downstream_cases: int = 20
    structure_regression: float = 0.005
    structure_gain: float = 0.01
    downstream_regression: float = 0.01
    p95_ratio: float = 2.0
    memory_mib: float = 36_000.0


def evidence_codes(evidence: DataFrame, policy: StructurePolicy) -> DataFrame:
    """(codes): what is too little, from rows (language, kind, n), kind being documents, pages, heading_edges, order_pairs, downstream_cases or a task of relations.

    Rows are summed by language and kind; a required pair without a row has 0. Other languages count for a task's total alone.
    """
    sums = evidence.groupBy("language", "kind").agg(F.sum("n").alias("n"))
    least = {k: getattr(policy, k) for k in ("documents", "pages", "heading_edges", "order_pairs", "downstream_cases")} | dict.fromkeys(TASKS, policy.relations_per_language)
    spark = evidence.sparkSession
    name = lambda k: f"relations:{{}}:{k}" if k in TASKS else f"{k}:{{}}"
    wanted = spark.createDataFrame([(v, k, m, "insufficient_" + name(k).format(v)) for v in policy.languages for k, m in least.items()], "language string, kind string, least int, code string")
    by_language = wanted.join(sums, ["language", "kind"], "left").select("code", "least", "n")
    totals = spark.createDataFrame([(t, policy.relations, f"insufficient_relations:{t}") for t in TASKS], "kind string, least int, code string")
    overall = totals.join(sums.groupBy("kind").agg(F.sum("n").alias("n")), "kind", "left").select("code", "least", "n")
    return by_language.unionByName(overall).where(F.coalesce("n", F.lit(0)) < F.col("least")).select(F.array("code").alias("codes"))


def structure_gate(evidence: DataFrame, scores: DataFrame, validity: DataFrame, runtime: DataFrame, policy: StructurePolicy = StructurePolicy()) -> DataFrame:
    """One row (eligible, accepted, failure_codes, best_gain).

    ``scores`` are (kind, scope, metric, baseline, candidate): structure metrics must not fall by more than their limit in any scope and rise by
    the material gain in one; downstream metrics must not fall by more than theirs. ``validity`` are (name, ok); ``runtime`` is one row of b_p95, c_p95 and
    c_memory_mib. Too little evidence makes the gate ineligible. A missing value fails its rule.
    """
    structure = F.col("kind") == "structure"
    delta = F.col("candidate") - F.col("baseline")
    held = F.when(structure, delta >= -policy.structure_regression).otherwise(F.col("candidate") >= F.col("baseline") - policy.downstream_regression)
    lost = F.when(~F.coalesce(held, F.lit(False)), F.concat_ws(":", F.concat("kind", F.lit("_regression")), "scope", "metric"))
    judged = scores.agg(F.collect_list(lost).alias("lost"), F.max(F.when(structure, delta)).alias("best_gain"))
    p95 = F.try_divide("c_p95", "b_p95") <= policy.p95_ratio
    frames = [
        evidence_codes(evidence, policy).withColumn("evidence", F.lit(True)),
        judged.select(F.concat("lost", failed({"no_material_structure_gain": F.coalesce("best_gain", F.lit(0.0)) >= policy.structure_gain})).alias("codes"), F.lit(False).alias("evidence"), "best_gain"),
        validity.where(~F.coalesce("ok", F.lit(False))).select(F.array(F.concat("name", F.lit("_invalid"))).alias("codes"), F.lit(False).alias("evidence")),
        runtime.select(failed({"latency_budget_exceeded": p95, "memory_budget_exceeded": F.col("c_memory_mib") <= policy.memory_mib}).alias("codes"), F.lit(False).alias("evidence")),
    ]
    rows = frames[1]
    for more in (frames[0], *frames[2:]):
        rows = rows.unionByName(more, allowMissingColumns=True)
    found = rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("failure_codes"), (F.count_if(F.col("evidence")) == 0).alias("eligible"), F.max("best_gain").alias("best_gain"))
    return found.select("eligible", (F.size("failure_codes") == 0).alias("accepted"), "failure_codes", "best_gain")


@dataclass(frozen=True)
class PreflightPolicy:
    """The state that a search must be in, and how near it must come to the exact one."""

    versions: dict[str, str]
    vector_type: str
    recall: float = 0.99
    fill: float = 0.99
    p95_ratio: float = 1.05
    recall_gain: float = 0.005


def preflight(state: DataFrame, policy: PreflightPolicy) -> DataFrame:
    """(reasons, decision) of each row of ``state``; without a reason it goes on to the full comparison.

    ``state`` has the versions' columns; rows, embedded, finite (all vectors), vector_type, index_valid; row_security, bypasses, owns, leaks (of
    probes by other owners); stable (the corpus), complete (the run); exact_used_index, coverage, natural_coverage; recall, plain_recall, fill, p95,
    exact_p95, violations. Reasons stand in the rules' order; a value that is missing, or not finite, fails.
    """
    versions = {f"unexpected_version:{name}": F.col(name) == want for name, want in policy.versions.items()}
    finite = F.lit(True)
    for name in ("recall", "plain_recall", "fill", "p95", "exact_p95"):
        finite &= F.col(name).isNotNull() & (F.abs(F.col(name).cast("double")) < float("inf"))
    ratio = F.try_divide(F.col("p95"), F.col("exact_p95"))
    finite = finite & (F.col("exact_p95") > 0)
    measured = lambda rule: ~F.coalesce(finite, F.lit(False)) | rule
    rules = {
        "incomplete_run": F.col("complete"), **versions,
        "vectors_missing": F.col("embedded") == F.col("rows"), "vectors_not_finite": F.col("finite"), "unexpected_vector_type": F.col("vector_type") == policy.vector_type, "index_invalid": F.col("index_valid"),
        "unsafe_role": F.col("row_security") & ~F.col("bypasses") & ~F.col("owns"), "owner_probe_failed": F.col("leaks") == 0, "corpus_changed": F.col("stable"),
        "exact_search_used_index": F.col("exact_used_index") == 0, "index_not_usable_in_every_scope": F.col("coverage") == 1.0, "measures_not_finite": finite,
        "recall_below_limit": measured(F.col("recall") >= policy.recall), "fill_below_limit": measured(F.col("fill") >= policy.fill), "p95_regressed": measured(ratio <= policy.p95_ratio), "no_recall_gain": measured(F.col("recall") - F.col("plain_recall") >= policy.recall_gain),
        "scope_violated": F.col("violations") == 0, "index_never_chosen": F.col("natural_coverage") != 0,
    }
    return state.withColumn("reasons", failed(rules)).withColumn("decision", F.when(F.size("reasons") == 0, "requires_full_comparison").otherwise("no_go"))
