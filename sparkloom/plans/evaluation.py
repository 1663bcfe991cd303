"""Queries: hierarchical expansion, ranking metrics, statistics, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hierarchy, metrics, vector
from .registry import query, table
from .retrieval import COSINE, VECTORS
from .views import CHUNKS_SQL, chunks

ANCHORS = """a AS (SELECT id AS anchor, id AS anchor_rank, document_id, coalesce(nullif(section_id, ''), 'legacy:' || heading_path) AS section, table_id, idx AS a_idx, page_start AS a_start, page_end AS a_end FROM chunks WHERE id % 50 = 0),
k AS (SELECT *, count(*) OVER (PARTITION BY document_id, section) AS n_anchors FROM a),
c AS (SELECT *, coalesce(nullif(section_id, ''), 'legacy:' || heading_path) AS section FROM chunks),
r AS (SELECT anchor, anchor_rank, id, abs(idx - a_idx) AS distance, CASE WHEN k.table_id = c.table_id THEN 0 WHEN k.section = c.section AND abs(idx - a_idx) = 1 THEN 1 WHEN k.section = c.section AND n_anchors >= 2 THEN 2
   WHEN k.section = c.section AND page_start <= a_end + 1 AND page_end >= a_start - 1 THEN 3 END AS priority FROM k JOIN c ON k.document_id = c.document_id AND id <> anchor),
f AS (SELECT * FROM r WHERE priority IS NOT NULL)"""


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    # Every 50th id is an anchor; ids are dense enough to rank by themselves up to ties, so the rank is by id.
    anchors = rows.where("id % 50 = 0").select("id", F.col("id").alias("rank"))
    return hierarchy.relatives(anchors, rows)


@query("hie1_4_relatives_per_anchor", f"WITH {CHUNKS_SQL}, {ANCHORS} SELECT anchor, id, priority, distance FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY priority, distance, id) AS n FROM f) WHERE n <= 4")
def hie4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four closest relatives of every anchor (every 50th chunk)."""
    order = Window.partitionBy("anchor").orderBy("priority", "distance", "id")
    return anchored(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 4").select("anchor", "id", "priority", "distance")


@query("hie5_collapsed_expansion", f"""WITH {CHUNKS_SQL}, {ANCHORS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY priority, distance, id) AS n FROM f) WHERE n <= 4),
m AS (SELECT id, min(anchor) AS anchor_rank, min(priority) AS priority, min(distance) AS distance FROM b GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY anchor_rank, priority, distance, id) AS position FROM m ORDER BY anchor_rank, priority, distance, id LIMIT 100""")
def hie5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.expanded(anchored(spark, sf_dir), 4, 100)


RANKED = f"""{VECTORS}, d AS (SELECT q.vec_id AS case_id, v.vec_id AS ref, q.label AS want, v.label, {COSINE} AS distance FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, ref) AS rank FROM d),
g AS (SELECT case_id, ref, 1 + ref % 3 AS grade FROM d WHERE want = label)"""


def rankings(spark: SparkSession, sf_dir: str, k: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rankings of every 50th vector, these cases and all items: one of the same label is relevant, graded 1 to 3 by its id."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    ranked = vector.nearest(rows, asked, k, exclude_self=True).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("ref"), "rank")
    return ranked, asked.select(F.col("vec_id").alias("case_id"), "label"), rows.select(F.col("vec_id").alias("ref"), "label", (1 + F.col("vec_id") % 3).alias("grade"))


@query("met1_3_recall_mrr_ndcg", f"""WITH {RANKED}, i AS (SELECT case_id, sum((2 ** grade - 1) / log2(n + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, ref) AS n FROM g) WHERE n <= 10 GROUP BY 1),
h AS (SELECT case_id, count(*) AS hits, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM rk JOIN g USING (case_id, ref) WHERE rank <= 10 GROUP BY 1),
t AS (SELECT case_id, count(*) AS n_relevant FROM g GROUP BY 1)
SELECT case_id, n_relevant, round(coalesce(hits, 0) / n_relevant, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM t JOIN i USING (case_id) LEFT JOIN h USING (case_id)""")
def met1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_metrics(*rankings(spark, sf_dir), 10)


@query("met5_abstention", "SELECT conv_id AS case_id, count(*) FILTER (WHERE role = 'assistant') = 0 AS abstained, CASE WHEN conv_id % 4 = 0 THEN count(*) FILTER (WHERE role = 'assistant') = 0 END AS correct_abstention FROM conversations GROUP BY 1")
def met5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cases without an answer are rightly abstained from; null where a case is answerable."""
    per = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg((F.count_if(F.col("role") == "assistant") == 0).alias("abstained"))
    return per.withColumn("correct_abstention", F.when(F.col("case_id") % 4 == 0, F.col("abstained")))


@query("met6_citation_metrics", """
WITH s AS (SELECT conv_id AS case_id, turn + 1 AS rank, length(text) % 17 AS ref FROM conversations),
c AS (SELECT conv_id AS case_id, unnest([1, 2, 2, 4, 9]) + (turn % 2) AS cited FROM conversations),
r AS (SELECT DISTINCT case_id, ref FROM s WHERE ref % 3 = 0),
u AS (SELECT DISTINCT case_id, cited FROM c), m AS (SELECT c.case_id, c.cited, k.rank IS NOT NULL AS valid FROM c LEFT JOIN (SELECT DISTINCT case_id, rank FROM s) k ON k.case_id = c.case_id AND k.rank = c.cited),
per AS (SELECT case_id, count(*) AS mentions, count(*) FILTER (WHERE valid) AS valid, coalesce(list_sort(list_distinct(list(cited) FILTER (WHERE NOT valid))), []) AS invalid FROM m GROUP BY 1),
x AS (SELECT u.case_id, u.cited, s.ref, r.ref IS NOT NULL AS good FROM u JOIN s ON s.case_id = u.case_id AND s.rank = u.cited LEFT JOIN r ON r.case_id = s.case_id AND r.ref = s.ref),
y AS (SELECT case_id, count(*) AS n_unique, count(*) FILTER (WHERE hit) AS hits FROM (SELECT case_id, cited, bool_or(good) AS hit FROM x GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT case_id, count(DISTINCT ref) AS found FROM x WHERE good GROUP BY 1), w AS (SELECT case_id, count(*) AS wanted FROM r GROUP BY 1),
j AS (SELECT per.*, coalesce(n_unique, 0) AS n_unique, CASE WHEN coalesce(n_unique, 0) = 0 THEN 0 ELSE hits / n_unique END AS p, CASE WHEN coalesce(wanted, 0) = 0 THEN 0 ELSE coalesce(found, 0) / wanted END AS r FROM per LEFT JOIN y USING (case_id) LEFT JOIN z USING (case_id) LEFT JOIN w USING (case_id))
SELECT case_id, round(valid / mentions, 6) AS validity, round(p, 6) AS precision_, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, invalid, n_unique FROM j""")
def met6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), "turn", (F.char_length("text") % 17).alias("ref"))
    sources = rows.select("case_id", (F.col("turn") + 1).alias("rank"), "ref")
    citations = rows.select("case_id", "turn", F.explode(F.array(*(F.lit(n).cast("long") for n in (1, 2, 2, 4, 9)))).alias("n")).select("case_id", (F.col("n") + F.col("turn") % 2).alias("cited"))
    return metrics.citation_metrics(citations, sources, sources.where("ref % 3 = 0").select("case_id", "ref").distinct())


@query("met9_single_gold_rank", f"""WITH {RANKED}, f AS (SELECT case_id, min(rank) AS r FROM rk WHERE want = label GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10, round(avg(CASE WHEN r <= 50 THEN 1.0 / r ELSE 0 END), 6) AS mrr FROM f""")
def met9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, asked, items = rankings(spark, sf_dir)
    several = items.groupBy("label").count().where("count > 1").select("label")
    hits = ranked.join(asked, "case_id").join(items.select("ref", "label"), ["ref", "label"]).groupBy("case_id").agg(F.min("rank").alias("r"))
    first = asked.join(several, "label", "left_semi").select("case_id").join(hits, "case_id", "left")
    within = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    return first.agg(F.count("*").alias("n"), within(1).alias("hit1"), within(10).alias("hit10"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


@query("met12_risk_coverage", """
WITH c AS (SELECT round((value * 7) % 1, 2) AS score, event_type <> 'error' AS supported FROM events), t AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9]) AS threshold)
SELECT threshold::DOUBLE AS threshold, round(count(*) FILTER (WHERE score >= threshold) / count(*), 6) AS coverage, CASE WHEN count(*) FILTER (WHERE score >= threshold) > 0 THEN round(count(*) FILTER (WHERE score >= threshold AND supported) / count(*) FILTER (WHERE score >= threshold), 6) END AS precision_ FROM c, t GROUP BY 1""")
def met12(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "events").select(F.round((F.col("value") * 7) % 1, 2).alias("score"), (F.col("event_type") != "error").alias("supported"))
    return metrics.risk_coverage(claims, [0.0, 0.25, 0.5, 0.75, 0.9])


@query("met13_threshold_choice", """
WITH c AS (SELECT d.lang, round((d.n_chars % 100) / 100.0, 2) AS score, l.quality = 1 AS supported FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8]) AS threshold),
s AS (SELECT threshold, lang, count(*) FILTER (WHERE score >= threshold) AS kept, count(*) FILTER (WHERE score >= threshold AND supported) AS good, count(*) AS n FROM c, t GROUP BY 1, 2),
o AS (SELECT threshold, sum(kept) / sum(n) AS coverage, sum(good) / sum(kept) AS p, bool_and(good >= 0.7 * kept) AS every_lang FROM s GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, round(coverage, 6) AS coverage, round(p, 6) AS precision_ FROM o WHERE every_lang AND p >= 0.8 ORDER BY coverage DESC, p DESC, threshold LIMIT 1""")
def met13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of most coverage whose precision holds overall and in every language."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    at = F.explode(F.array(*(F.lit(t) for t in (0.0, 0.2, 0.4, 0.6, 0.8)))).alias("threshold")
    rows = docs.join(labels, "doc_id").groupBy("lang", F.round((F.col("n_chars") % 100) / 100.0, 2).alias("score"), "quality").agg(F.count("*").alias("c")).select("*", at)
    kept = F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("c")).otherwise(0))
    good = F.sum(F.when((F.col("score") >= F.col("threshold")) & (F.col("quality") == 1), F.col("c")).otherwise(0))
    per = rows.groupBy("threshold", "lang").agg(kept.alias("kept"), good.alias("good"), F.sum("c").alias("n"))
    whole = per.groupBy("threshold").agg((F.sum("kept") / F.sum("n")).alias("cov"), (F.sum("good") / F.sum("kept")).alias("p"), F.bool_and(F.col("good") >= 0.7 * F.col("kept")).alias("every_lang"))
    return whole.where("every_lang and p >= 0.8").orderBy(F.desc("cov"), F.desc("p"), "threshold").limit(1).select("threshold", F.round("cov", 6).alias("coverage"), F.round("p", 6).alias("precision_"))


@query("met15_mapping_integrity", """
WITH a AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) SELECT d.source, count(*) AS n, count(a.doc_id) AS covered, count(*) FILTER (WHERE a.n > 1) AS duplicated, round(count(a.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY 1""")
def met15(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("m"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(mapped, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("m").alias("covered"), F.count_if(F.col("m") > 1).alias("duplicated"), F.round(F.count("m") / F.count("*"), 6).alias("coverage"))


@query("sta4_sign_test", """
WITH p AS (SELECT l_suppkey, sum(CASE WHEN l_discount > l_tax THEN 1 ELSE 0 END)::BIGINT AS wins, sum(CASE WHEN l_discount < l_tax THEN 1 ELSE 0 END)::BIGINT AS losses FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT l_suppkey, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))))) END, 6) AS p FROM p""")
def sta4(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_suppkey").agg(F.count_if(F.expr("l_discount > l_tax")).alias("wins"), F.count_if(F.expr("l_discount < l_tax")).alias("losses"))
    return li.withColumn("p", F.round(metrics.sign_test(F.col("wins"), F.col("losses")), 6))


@query("sta7_config_sweep", """
WITH g AS (SELECT x AS k1, y AS b FROM (SELECT unnest([0.8, 1.2, 1.6]) AS x), (SELECT unnest([0.25, 0.5, 0.75]) AS y)),
s AS (SELECT k1, b, round(avg(n_chars / (n_chars + 1000 * k1 * (1 - b + b * n_chars / 2400))), 9) AS score FROM documents, g GROUP BY 1, 2)
SELECT k1::DOUBLE AS k1, b::DOUBLE AS b, score FROM s ORDER BY score DESC, k1, b LIMIT 1""")
def sta7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all combinations of two settings, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k1"), F.lit(b).alias("b")) for k in (0.8, 1.2, 1.6) for b in (0.25, 0.5, 0.75)))).alias("g")
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").groupBy("n_chars").agg(F.count("*").alias("c")).select("n_chars", "c", pairs).select("n_chars", "c", "g.k1", "g.b")
    value = n / (n + 1000 * F.col("k1") * (1 - F.col("b") + F.col("b") * n / 2400))
    return rows.groupBy("k1", "b").agg(F.round(F.sum(value * F.col("c")) / F.sum("c"), 9).alias("score")).orderBy(F.desc("score"), "k1", "b").limit(1)


@query("sta8_peak_concurrency", """
WITH e AS (SELECT event_type, ts AS t, 1 AS d FROM events UNION ALL SELECT event_type, ts + to_microseconds(cast(value * 1e6 * 60 AS BIGINT)), -1 FROM events),
s AS (SELECT event_type, t, d, sum(d) AS s FROM e GROUP BY 1, 2, 3)
SELECT event_type, max(o)::BIGINT AS peak FROM (SELECT event_type, sum(s) OVER (PARTITION BY event_type ORDER BY t, d DESC) AS o FROM s) GROUP BY 1""")
def sta8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most jobs of a type that run at once; a value is a job's minutes."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_type", start.alias("start"), (start + F.round(F.col("value") * 1e6 * 60).cast("long")).alias("stop"))
    return metrics.peak_concurrency(rows, "event_type")


@query("gat3_slice_decisions", """
WITH p AS (SELECT source, avg(CASE WHEN doc_id % 2 = 0 THEN n_chars END) AS base, avg(CASE WHEN doc_id % 2 = 1 THEN n_chars END) AS cand, count(*) AS n FROM documents GROUP BY 1)
SELECT source, n, round(cand / base, 6) AS ratio, CASE WHEN base IS NULL OR cand IS NULL OR n < 20 THEN 'insufficient' WHEN cand < 0.99 * base THEN 'regressed' WHEN cand > 1.01 * base THEN 'improved' ELSE 'equal' END AS decision FROM p""")
def gat3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision per slice: more than one percent below the baseline is a regression, few cases decide nothing."""
    half = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("n_chars")))
    per = table(spark, sf_dir, "documents").groupBy("source").agg(half(0).alias("base"), half(1).alias("cand"), F.count("*").alias("n"))
    few = F.col("base").isNull() | F.col("cand").isNull() | (F.col("n") < 20)
    decision = F.when(few, "insufficient").when(F.expr("cand < 0.99 * base"), "regressed").when(F.expr("cand > 1.01 * base"), "improved").otherwise("equal")
    return per.select("source", "n", F.round(F.col("cand") / F.col("base"), 6).alias("ratio"), decision.alias("decision"))


@query("gat1_gate_failures", """
WITH m AS (SELECT event_type, quantile_disc(value, 0.95) AS p95, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, list_filter([CASE WHEN p95 > 3.2 * mean THEN 'latency_tail' END, CASE WHEN n < 2000 THEN 'few_cases' END, CASE WHEN mean > 50 THEN 'latency_mean' END], lambda x: x IS NOT NULL) AS failures FROM m""")
def gat1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the rules that a group fails; none is a pass."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    rules = {"latency_tail": F.expr("p95 > 3.2 * mean"), "few_cases": F.col("n") < 2000, "latency_mean": F.col("mean") > 50}
    return m.select("event_type", F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items()))).alias("failures"))
