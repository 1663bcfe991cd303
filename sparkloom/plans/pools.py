"""Queries: pools of evaluated cases, paired comparisons, gates, slices, trees of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, stats, vector
from .guards import A, GUARD, guarded
from .registry import query, table
from .retrieval import COSINE, VECTORS
from .views import as_sql

#: Evaluated cases: an event is a case, its type the pool.
CASES = {
    "case_id": "event_id", "pool": "event_type", "cluster_id": "user_id", "lang": "case user_id % 3 when 0 then 'ru' when 1 then 'en' else 'zh' end", "answerable": "event_id % 4 <> 0",
    "recall": "case when event_id % 9 = 0 then null else ((event_id * 7) % 11) / 10.0 end", "mrr": "((event_id * 3) % 11) / 10.0", "ndcg": "((event_id * 5) % 11) / 10.0",
    "baseline": "case when event_id % 9 = 0 then null else ((event_id * 7) % 11) / 10.0 end", "candidate": "case when event_id % 9 = 0 then null else ((event_id * 7 + event_id % 5) % 11) / 10.0 end",
    "returned": "(event_id * 3) % 5", "abstained": "(event_id * 3) % 5 = 0", "latency": "value",
}
K = f"WITH {as_sql('cases', CASES, 'events')} "
NEAREST = "max(CASE WHEN r = ceil({0} * n - 1e-9) THEN latency END)"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{x} as {c}" for c, x in CASES.items()))


@query("agg2_scalar_count", "SELECT count(*) AS n FROM documents WHERE source = 'src1'")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src1'").agg(F.count("*").alias("n"))


@query("agg3_outer_join_counts", "SELECT c.c_nationkey, count(*) AS all_rows, count(o.o_orderkey) AS orders, count(DISTINCT c.c_custkey) FILTER (WHERE o.o_orderkey IS NULL) AS without FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%' GROUP BY 1")
def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and matches of an outer join, which differ by the customers without a match."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    both = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left")
    return both.groupBy("c_nationkey").agg(F.count("*").alias("all_rows"), F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


@query("agg13_macro_mean", K + "SELECT lang, round(avg(recall), 6) AS recall, count(recall) AS eligible FROM cases GROUP BY 1")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("lang").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("recall").alias("eligible"))


@query("agg19_pool_aggregates", K + f""", q AS (SELECT pool, {NEAREST.format(0.5)} AS latency_p50, {NEAREST.format(0.95)} AS latency_p95 FROM (SELECT pool, latency, row_number() OVER (PARTITION BY pool ORDER BY latency) AS r, count(*) OVER (PARTITION BY pool) AS n FROM cases) GROUP BY 1)
SELECT c.pool, count(*) FILTER (WHERE answerable) AS answerable_cases, count(*) FILTER (WHERE NOT answerable) AS no_answer_cases, round(avg(recall) FILTER (WHERE answerable), 6) AS recall, round(avg(mrr) FILTER (WHERE answerable), 6) AS mrr, round(avg(ndcg) FILTER (WHERE answerable), 6) AS ndcg,
round(avg((returned > 0)::INT) FILTER (WHERE NOT answerable), 6) AS false_positive_rate, sum(returned) AS returned_count, count(*) FILTER (WHERE abstained) AS abstained_count, sum(returned) FILTER (WHERE NOT answerable) AS no_answer_returned, count(*) FILTER (WHERE NOT answerable AND abstained) AS no_answer_abstained,
round(avg(latency), 6) AS latency_mean, any_value(latency_p50) AS latency_p50, any_value(latency_p95) AS latency_p95 FROM cases c JOIN q USING (pool) GROUP BY c.pool""")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pool_aggregates(cases(spark, sf_dir))


@query("agg22_paired_distribution", K + """, d AS (SELECT pool, round(candidate - baseline, 6) AS delta FROM cases WHERE baseline IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY delta) AS r, count(*) OVER (PARTITION BY pool) AS n FROM d)
SELECT pool, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, max(CASE WHEN r = ceil(0.95 * n - 1e-9) THEN delta END) AS p95 FROM r GROUP BY 1""")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and 95th percentile of the paired differences of every pool."""
    rows = cases(spark, sf_dir).where("baseline is not null").select("pool", F.round(F.col("candidate") - F.col("baseline"), 6).alias("delta"))
    ranked = evaluation.ranked_values(rows, "pool", "delta")
    at = lambda rank: evaluation.value_at(rank, "delta")
    n = F.col("n")
    got = ranked.groupBy("pool").agg(F.round(F.sum(F.col("delta") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(F.floor((n + 1) / 2)).alias("a"), at(F.floor((n + 2) / 2)).alias("b"), at(F.ceil(0.95 * n - 1e-9)).alias("p95"))
    return got.select("pool", "mean", F.round((F.col("a") + F.col("b")) / 2, 6).alias("median"), "p95")


@query("agg23_gold_coverage", """WITH r AS (SELECT unnest(['lang:' || coalesce(lang, 'none'), 'source:' || source, 'quality:' || quality, 'toxic:' || toxic]) AS k FROM documents JOIN labels USING (doc_id)) SELECT split_part(k, ':', 1) AS dimension, split_part(k, ':', 2) AS value, count(*) AS n, count(*) >= 20 AS enough FROM r GROUP BY ALL""")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labelled documents every value of every dimension has, and whether they fill a quota of 20."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "source").join(table(spark, sf_dir, "labels"), "doc_id")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("lang", "source", "quality", "toxic"))))
    counted = rows.select(pairs.alias("p")).select("p.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("enough", F.col("n") >= 20)


EDGES = """g AS (SELECT o_orderpriority AS lang, o_custkey AS source, o_orderkey AS target FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT o_orderpriority AS lang, o_custkey AS source, o_orderkey AS target FROM orders WHERE o_orderkey % 4 <> 0),
e AS (SELECT coalesce(g.lang, p.lang) AS lang, count(g.lang) AS gold, count(p.lang) AS predicted, count(*) FILTER (WHERE g.lang IS NOT NULL AND p.lang IS NOT NULL) AS tp FROM g FULL JOIN p ON g.lang = p.lang AND g.source = p.source AND g.target = p.target GROUP BY 1)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("lang"), F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    return evaluation.edge_counts(rows.where("target % 3 <> 0"), rows.where("target % 4 <> 0"), "lang")


@query("agg26_micro_f1", f"WITH {EDGES} SELECT lang, gold, predicted, tp AS true_positive, round(tp / predicted, 6) AS precision_, round(tp / gold, 6) AS recall, round(2.0 * tp / (predicted + gold), 6) AS f1 FROM e")
def agg26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    scores = evaluation.set_scores(F.col("true_positive"), F.col("predicted"), F.col("gold"))
    return rows.withColumns({k: F.round(v, 6) for k, v in scores.items()})


@query("agg27_least_coverage", f"WITH {EDGES} SELECT round(min(tp / gold), 6) AS least_coverage, bool_and(tp >= 0.7 * gold) AS all_valid, count(*) FILTER (WHERE tp < 0.7 * gold) AS failures FROM e")
def agg27(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("true_positive") >= 0.7 * F.col("gold")
    return edges(spark, sf_dir).agg(F.round(F.min(F.col("true_positive") / F.col("gold")), 6).alias("least_coverage"), F.bool_and(good).alias("all_valid"), F.count_if(~good).alias("failures"))


@query("met14_order_pairs", """WITH o AS (SELECT conv_id AS document, turn FROM conversations), p AS (SELECT document, turn AS block, (turn * 3) % 4 AS position FROM o WHERE turn % 5 <> 4), q AS (SELECT a.document, a.turn AS before, b.turn AS after FROM o a JOIN o b ON b.document = a.document AND b.turn = a.turn + 1),
m AS (SELECT q.document, x.position AS xa, y.position AS ya FROM q LEFT JOIN p x ON x.document = q.document AND x.block = q.before LEFT JOIN p y ON y.document = q.document AND y.block = q.after)
SELECT document, count(*) AS gold, count(*) FILTER (WHERE xa IS NOT NULL AND ya IS NOT NULL) AS covered, count(*) FILTER (WHERE xa < ya) AS correct, round(count(*) FILTER (WHERE xa IS NOT NULL AND ya IS NOT NULL) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE xa < ya) / count(*), 6) AS score FROM m GROUP BY 1""")
def met14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns as pairs in order, against an order that moves some and lacks others."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), "turn")
    following = F.lead("turn").over(Window.partitionBy("document").orderBy("turn"))
    pairs = rows.select("document", F.col("turn").alias("before"), following.alias("after")).where("after = before + 1")
    return evaluation.order_scores(pairs, rows.where("turn % 5 <> 4").select("document", F.col("turn").alias("block"), ((F.col("turn") * 3) % 4).alias("position")))


def overlap_sql(k: int) -> str:
    half = COSINE.replace("q.e", "list_slice(q.e, 1, 48)").replace("v.e", "list_slice(v.e, 1, 48)")
    top = "SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id, {0} AS distance FROM v q, v WHERE q.vec_id % 50 = 0)) WHERE r <= {1}"
    return f"x AS ({top.format(COSINE, k)}), y AS ({top.format(half, k)}), o AS (SELECT x.query_id, count(y.vec_id) AS same FROM x LEFT JOIN y ON y.query_id = x.query_id AND y.vec_id = x.vec_id GROUP BY 1)"


@query("agg28_oracle_recall", f"WITH {VECTORS}, {overlap_sql(10)} SELECT count(*) AS queries, round(avg(same / 10), 6) AS oracle_recall, round(avg((same >= 5)::INT), 6) AS half_right, 1.0 AS fill_rate, 0 AS violations FROM o")
def agg28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's ten exact neighbours, those among its ten by 48 of 64 dimensions; whether ten came back, and none from outside."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    short = rows.select("vec_id", F.slice("embedding", 1, 48).alias("embedding"))
    exact, fast = (vector.nearest(r, r.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id") for r in (rows, short))
    got = exact.join(fast.withColumn("y", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("y").alias("same"))
    filled = fast.groupBy("query_id").agg(F.count("*").alias("n"))
    outside = fast.join(rows, "vec_id", "left_anti").groupBy("query_id").agg(F.count("*").alias("bad"))
    both = got.join(filled, "query_id", "left").join(outside, "query_id", "left")
    return both.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("same") / 10), 6).alias("oracle_recall"), F.round(F.avg((F.col("same") >= 5).cast("double")), 6).alias("half_right"), F.round(F.avg((F.col("n") >= 10).cast("double")), 6).alias("fill_rate"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"))


@query("agg35_paired_passes", K + "SELECT category, count(*) AS n, count(*) FILTER (WHERE baseline >= 0.5) AS baseline_passed, count(*) FILTER (WHERE candidate >= 0.5) AS candidate_passed, count(*) FILTER (WHERE baseline IS NULL) + count(*) FILTER (WHERE candidate IS NULL) AS errors FROM (SELECT *, unnest([lang, pool, CASE WHEN answerable THEN 'answerable' ELSE 'safety' END]) AS category FROM cases) GROUP BY 1")
def agg35(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.explode(F.array("lang", "pool", F.when(F.col("answerable"), "answerable").otherwise("safety"))).alias("category")
    passed = lambda c: F.count_if(F.coalesce(F.col(c) >= 0.5, F.lit(False))).alias(f"{c}_passed")
    rows = cases(spark, sf_dir).select(category, "baseline", "candidate")
    return rows.groupBy("category").agg(F.count("*").alias("n"), passed("baseline"), passed("candidate"), (F.count_if(F.col("baseline").isNull()) + F.count_if(F.col("candidate").isNull())).alias("errors"))


STAGES = "st AS (SELECT mentioned AS primary_mentioned, unsupported_values AS primary_unsupported, CASE WHEN e % 7 = 0 THEN mentioned ELSE greatest(mentioned - 1, 0) END AS final_mentioned, CASE WHEN e % 7 = 0 THEN unsupported_values ELSE 0 END AS final_unsupported, CASE WHEN e % 5 <> 0 THEN 0.9 END AS primary_recall, CASE WHEN e % 5 <> 0 THEN 0.8 END AS final_recall FROM g)"
SUMMARY = """sm AS (SELECT count(*) AS cases, count(*) FILTER (WHERE primary_unsupported > 0) AS repairs, count(*) FILTER (WHERE primary_unsupported > 0 AND final_unsupported = 0) AS repaired, sum(primary_unsupported) AS primary_unsupported, round(sum(primary_unsupported) / sum(primary_mentioned), 6) AS primary_rate,
  round(count(*) FILTER (WHERE primary_unsupported > 0) / count(*), 6) AS primary_unsafe_rate, round(avg(primary_recall), 6)::DOUBLE AS primary_recall, sum(final_unsupported) AS final_unsupported, round(sum(final_unsupported) / sum(final_mentioned), 6) AS final_rate, round(count(*) FILTER (WHERE final_unsupported > 0) / count(*), 6) AS final_unsafe_rate, round(avg(final_recall), 6)::DOUBLE AS final_recall FROM st)"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.col("e") % 7 == 0
    rows = guarded(spark, sf_dir).select(
        F.col("mentioned").alias("primary_mentioned"), F.col("unsupported_values").alias("primary_unsupported"), F.when(again, F.col("mentioned")).otherwise(F.greatest(F.col("mentioned") - 1, F.lit(0))).alias("final_mentioned"), F.when(again, F.col("unsupported_values")).otherwise(0).alias("final_unsupported"),
        F.when(F.col("e") % 5 != 0, 0.9).alias("primary_recall"), F.when(F.col("e") % 5 != 0, 0.8).alias("final_recall"),
    )
    return evaluation.stage_summary(rows)


@query("agg36_stage_summary", f"{A}, {GUARD}, {STAGES}, {SUMMARY} SELECT * FROM sm")
def agg36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir)


@query("smp22_guard_decision", f"""{A}, {GUARD}, {STAGES}, {SUMMARY}, r AS (SELECT list_filter([CASE WHEN final_rate > 0.02 THEN 'final_rate' END, CASE WHEN primary_rate > 0 AND 1 - final_rate / primary_rate < 0.8 THEN 'reduction' END, CASE WHEN final_unsafe_rate > 0.05 THEN 'unsafe_cases' END, CASE WHEN final_recall + 0.05 < primary_recall THEN 'recall' END], lambda x: x IS NOT NULL) AS reasons FROM sm)
SELECT reasons, CASE WHEN len(reasons) = 0 THEN 'GO' ELSE 'NO-GO' END AS decision FROM r""")
def smp22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules = [("final_rate", c("final_rate") > 0.02), ("reduction", (c("primary_rate") > 0) & (1 - c("final_rate") / c("primary_rate") < 0.8)), ("unsafe_cases", c("final_unsafe_rate") > 0.05), ("recall", c("final_recall") + 0.05 < c("primary_recall"))]
    return evaluation.gate(summary(spark, sf_dir), rules).select("reasons", "decision")


SLICES = """sl AS (SELECT dimension, value, metric, count(*) AS n, avg(baseline) AS b, avg(candidate) AS c, bool_and(candidate + 1e-12 >= baseline) AS none_worse FROM (
  SELECT baseline, candidate, unnest(['language', 'hop', 'leakage']) AS dimension, unnest([lang, pool || cluster_id, 'refusal']) AS value, 'recall' AS metric FROM cases WHERE answerable AND baseline IS NOT NULL) GROUP BY 1, 2, 3),
dc AS (SELECT dimension, value, metric, n, round(b, 6)::DOUBLE AS baseline, round(c, 6)::DOUBLE AS candidate, round(CASE WHEN dimension = 'leakage' THEN 1.0 WHEN n >= 50 THEN b - 0.01 ELSE b END, 6)::DOUBLE AS minimum, CASE WHEN dimension = 'leakage' THEN c = 1 WHEN n >= 50 THEN c >= b - 0.01 ELSE none_worse END AS passed FROM sl)"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).where("answerable")
    named = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("language", F.col("lang")), ("hop", F.concat("pool", "cluster_id")), ("leakage", F.lit("refusal"))))))
    return evaluation.slice_decisions(rows.select("baseline", "candidate", named.alias("s")).select("baseline", "candidate", "s.*", F.lit("recall").alias("metric")), 0.01, 50)


@query("smp23_slice_decisions", f"{K}, {SLICES} SELECT * FROM dc")
def smp23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir)


@query("gat2_release_gate", f"""{K}, {SLICES}, t AS (SELECT count(*) FILTER (WHERE NOT passed AND dimension = 'language') AS languages, count(*) FILTER (WHERE NOT passed AND dimension = 'leakage') AS leaks, max(candidate - baseline) FILTER (WHERE dimension = 'leakage') AS gain FROM dc),
r AS (SELECT list_filter([CASE WHEN languages > 0 THEN 'language_slices' END, CASE WHEN leaks > 0 THEN 'leakage' END, CASE WHEN gain < 0.01 THEN 'no_gain' END], lambda x: x IS NOT NULL) AS reasons FROM t) SELECT reasons, CASE WHEN len(reasons) = 0 THEN 'GO' ELSE 'NO-GO' END AS decision FROM r""")
def gat2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release goes where no language loses, nothing leaks and the whole gains."""
    failed = lambda d: F.count_if(~F.col("passed") & (F.col("dimension") == d))
    totals = slices(spark, sf_dir).agg(failed("language").alias("languages"), failed("leakage").alias("leaks"), F.max(F.when(F.col("dimension") == "leakage", F.col("candidate") - F.col("baseline"))).alias("gain"))
    return evaluation.gate(totals, [("language_slices", F.col("languages") > 0), ("leakage", F.col("leaks") > 0), ("no_gain", F.col("gain") < 0.01)]).select("reasons", "decision")


@query("gat4_structure_gate", f"WITH {EDGES}, s AS (SELECT lang, tp / gold AS coverage, 2.0 * tp / (predicted + gold) AS f1 FROM e), r AS (SELECT lang, list_filter([CASE WHEN coverage < 0.75 THEN 'coverage' END, CASE WHEN f1 < 0.7 THEN 'f1' END], lambda x: x IS NOT NULL) AS reasons FROM s) SELECT lang, reasons, CASE WHEN len(reasons) = 0 THEN 'GO' ELSE 'NO-GO' END AS decision FROM r")
def gat4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.set_scores(F.col("true_positive"), F.col("predicted"), F.col("gold"))
    return evaluation.gate(edges(spark, sf_dir).withColumns(scores), [("coverage", F.col("recall") < 0.75), ("f1", F.col("f1") < 0.7)]).select("lang", "reasons", "decision")


@query("gat5_search_preflight", f"""WITH {VECTORS}, {overlap_sql(10)}, a AS (SELECT avg(same / 10) AS recall FROM o), n AS (SELECT count(*) FILTER (WHERE embedding IS NULL) AS empty, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong FROM embeddings),
r AS (SELECT list_filter([CASE WHEN empty > 0 THEN 'vectors_missing' END, CASE WHEN wrong > 0 THEN 'wrong_dimension' END, CASE WHEN recall < 0.99 THEN 'recall_below_0_99' END], lambda x: x IS NOT NULL) AS reasons FROM a, n) SELECT reasons, CASE WHEN len(reasons) = 0 THEN 'GO' ELSE 'NO-GO' END AS decision FROM r""")
def gat5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a faster search may go on to a full comparison."""
    state = table(spark, sf_dir, "embeddings").agg(F.count_if(F.col("embedding").isNull()).alias("empty"), F.count_if(F.size("embedding") != 64).alias("wrong"))
    both = state.crossJoin(agg28(spark, sf_dir).select("oracle_recall"))  # one row each
    return evaluation.gate(both, [("vectors_missing", F.col("empty") > 0), ("wrong_dimension", F.col("wrong") > 0), ("recall_below_0_99", F.col("oracle_recall") < 0.99)]).select("reasons", "decision")


@query("gat6_answer_checks", f"""{A}, {GUARD}, c AS (SELECT g.case_id, list_filter([CASE WHEN g.e % 10 = 3 THEN 'scope' END, CASE WHEN NOT contains(a.evidence, 'bar') OR g.e % 11 = 0 THEN 'exact_quote' END, CASE WHEN g.unsupported_values > 0 THEN 'number_unit' END, CASE WHEN (g.e % 4 = 0) <> contains(a.answer, 'days') THEN 'answerability' END], lambda x: x IS NOT NULL) AS failures FROM g JOIN ans a USING (case_id))
SELECT case_id, failures, len(failures) = 0 AS passed FROM c""")
def gat6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's deterministic checks: its scope, quotes held by the evidence, numbers supported, abstention as expected."""
    from .guards import answers

    rows = guarded(spark, sf_dir).join(answers(spark, sf_dir).select("case_id", "answer", "evidence"), "case_id")
    e = F.col("e")
    quote = F.when(e % 11 == 0, F.lit("not there")).otherwise(F.lit("bar"))
    rules = [("scope", e % 10 == 3), ("exact_quote", ~F.col("evidence").contains(quote)), ("number_unit", F.col("unsupported_values") > 0), ("answerability", (e % 4 == 0) != F.col("answer").contains("days"))]
    return evaluation.gate(rows, rules).select("case_id", F.col("reasons").alias("failures"), (F.size("reasons") == 0).alias("passed"))


@query("met4_input_problems", "WITH g AS (SELECT l_orderkey AS case_id, l_partkey % 50 AS ref, CASE WHEN l_partkey % 97 = 0 THEN -1 WHEN l_partkey % 89 = 0 THEN 'nan'::DOUBLE ELSE l_quantity * 2.2 END AS grade FROM lineitem) SELECT case_id, count(*) - count(DISTINCT ref) AS repeated, count(*) FILTER (WHERE isnan(grade) OR grade < 0 OR grade > 100) AS bad_grades FROM g GROUP BY 1")
def met4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades that repeat a ref, or that aren't finite numbers from 0 to 100."""
    grade = F.when(F.col("l_partkey") % 97 == 0, -1.0).when(F.col("l_partkey") % 89 == 0, float("nan")).otherwise(F.col("l_quantity") * 2.2)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 50).alias("ref"), grade.alias("grade"))
    return rows.groupBy("case_id", "ref").agg(F.count("*").alias("n"), F.count_if(F.isnan("grade") | (F.col("grade") < 0) | (F.col("grade") > 100)).alias("bad")).groupBy("case_id").agg((F.sum("n") - F.count("*")).alias("repeated"), F.sum("bad").alias("bad_grades"))


@query("met8_deduplicated_ndcg")
def met8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a conversation's turns (by rank) that hold evidence: a rank matches the keys of its length modulo 3 and 5."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("rank"), F.explode(F.array_distinct(F.array(F.char_length("text") % 3, F.char_length("text") % 5))).alias("key"))
    grades = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id")).distinct().select("case_id", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("key")).withColumn("grade", 1 + (F.col("key") + F.col("case_id")) % 3)
    return evaluation.dedup_ndcg(rows, grades)


@query("met10_route_recall", f"""WITH {VECTORS}, d AS (SELECT q.vec_id AS case_id, q.label AS want, v.label AS got, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE}, v.vec_id) AS r FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT case_id, count(DISTINCT got) AS labels, count(DISTINCT got) FILTER (WHERE got IN (want, (want + 1) % 10)) / 2 AS route_recall, count(DISTINCT got) FILTER (WHERE got IN (want, (want + 1) % 10)) = 2 AS full_evidence FROM d WHERE r <= 10 GROUP BY 1""")
def met10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two relevant labels, those among the ten nearest rows; whether both are."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    near = vector.nearest(rows, asked, 10, exclude_self=True).select(F.col("query_id").alias("case_id"), "vec_id").join(rows.select("vec_id", F.col("label").alias("got")), "vec_id")
    both = near.select("case_id", "got").distinct().join(asked.select(F.col("vec_id").alias("case_id"), F.col("label").alias("want")), "case_id")
    hit = F.col("got").isin(F.col("want"), (F.col("want") + 1) % 10)
    got = both.groupBy("case_id").agg(F.count("*").alias("labels"), F.count_if(hit).alias("hits"))
    return got.select("case_id", "labels", (F.col("hits") / 2).alias("route_recall"), (F.col("hits") == 2).alias("full_evidence"))


@query("met11_answerability", K + "SELECT lang, count(*) AS n, count(*) FILTER (WHERE answerable <> abstained) AS correct, round(count(*) FILTER (WHERE answerable <> abstained) / count(*), 6) AS accuracy FROM cases GROUP BY 1")
def met11(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.count_if(F.col("answerable") != F.col("abstained"))
    return cases(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("accuracy"))


@query("sta1_cluster_bootstrap")
def sta1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the paired improvement of every pool, users being clusters."""
    return evaluation.bootstrap(cases(spark, sf_dir).where("baseline is not null"), "pool", 500, 7)


@query("sta2_stratified_bootstrap")
def sta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with languages resampled on their own, at a level that holds for all pools together."""
    return evaluation.bootstrap(cases(spark, sf_dir).where("baseline is not null"), "pool", 500, 7, 1 - 0.05 / 5, "lang")


@query("sta3_paired_bootstrap")
def sta3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case a cluster of its own."""
    return evaluation.bootstrap(cases(spark, sf_dir).where("baseline is not null").withColumn("cluster_id", F.col("case_id")), "lang", 500, 7)


@query("sta5_shared_clusters", """WITH RECURSIVE e AS (SELECT doc_id AS c, 't' || md5(coalesce(text, '')) AS d FROM documents UNION SELECT doc_id, 'n' || n_chars FROM documents WHERE n_chars > 2000), l AS (SELECT DISTINCT a.c AS x, b.c AS y FROM e a JOIN e b USING (d)), r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT x AS "case", min(y) AS cluster FROM r GROUP BY 1""")
def sta5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a text or, if long, a length, directly or through others."""
    rows = table(spark, sf_dir, "documents")
    same = rows.select("doc_id", F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))).alias("d"))
    size = rows.where("n_chars > 2000").select("doc_id", F.concat(F.lit("n"), "n_chars").alias("d"))
    return stats.shared_clusters(same.unionByName(size), "doc_id", "d")


@query("sta10_link_cycles", """WITH RECURSIVE k AS (SELECT o_orderkey AS child, CASE WHEN o_custkey % 50 = 0 THEN coalesce(lag(o_orderkey) OVER w, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) ELSE lag(o_orderkey) OVER w END AS parent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r(child, pos, depth) AS (SELECT child, parent, 1 FROM k WHERE parent IS NOT NULL UNION ALL SELECT r.child, k.parent, depth + 1 FROM r JOIN k ON k.child = r.pos WHERE k.parent IS NOT NULL AND depth < 60)
SELECT child, CASE WHEN max(depth) >= 60 THEN NULL ELSE max(depth) END AS depth FROM r GROUP BY 1""")
def sta10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of every node below its root, null where its links end in a cycle: a customer's orders are chains, those of some customers rings."""
    whole = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.lag("o_orderkey").over(whole)
    last = F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    parent = F.when(F.col("o_custkey") % 50 == 0, F.coalesce(before, last)).otherwise(before)
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), parent.alias("parent"))
    return evaluation.ancestors(links).select("child", "depth")
