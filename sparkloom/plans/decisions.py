"""Queries: claims with their places, answers without the rejected ones, and decisions by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import claims
from ..operators import decisions
from .registry import query, table

#: Every text as an answer with a heading, citations and a list of sources; its pieces are the sentences with what stands before each.
CLAIMS = """WITH a AS (SELECT conv_id * 1000 + turn AS id, '# Title' || chr(10) || text || '  [' || (turn % 9) || '][2]. Sources' || chr(10) || chr(10) || chr(10) || '1. See page ' || turn || '; end' AS answer FROM conversations WHERE text IS NOT NULL),
p AS (SELECT id, answer, unnest(regexp_extract_all(answer, '[\\n.!?。！？;；]*[^\\n.!?。！？;；]+[.!?。！？;；]*')) AS piece, generate_subscripts(regexp_extract_all(answer, '[\\n.!?。！？;；]*[^\\n.!?。！？;；]+[.!?。！？;；]*'), 1) AS i FROM a),
o AS (SELECT *, regexp_replace(piece, '^[\\n.!?。！？;；]+', '') AS raw, sum(length(piece)) OVER (PARTITION BY id ORDER BY i) AS stop FROM p),
q AS (SELECT *, (stop - length(raw))::INT AS start, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS visible FROM o),
c AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(visible, '\\[\\d{1,3}\\]', '', 'g')), '^\\s*(?:#{1,6}\\s+|[-*•]\\s+|\\d{1,3}[.)]\\s+)', ''), '[.!?。！？;]+$', '')) AS claim FROM q),
s AS (SELECT *, starts_with(visible, '#') OR (claim LIKE '%:' AND NOT regexp_matches(visible, '\\[\\d{1,3}\\]')) OR lower(claim) IN ('sources', 'источники', '来源') AS non_factual FROM c WHERE visible <> '' AND claim <> '')"""


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    answer = F.concat(F.lit("# Title\n"), "text", F.lit("  ["), (F.col("turn") % 9).cast("string"), F.lit("][2]. Sources\n\n\n1. See page "), turn, F.lit("; end"))
    return table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answer.alias("answer"))


@query("chk13_claim_spans", f"{CLAIMS} SELECT id, (i - 1)::INT AS n, start, stop::INT AS stop, claim, non_factual FROM s")
def chk13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of answers with their places."""
    return claims.claim_spans(cited_answers(spark, sf_dir), "id", "answer").select("id", "n", "start", "stop", "claim", "non_factual")


@query("chk14_answers_by_offsets", f"""{CLAIMS}, r AS (SELECT id, i FROM s WHERE NOT non_factual AND (id + i - 1) % 3 = 0),
k AS (SELECT o.id, string_agg(CASE WHEN r.i IS NULL THEN piece ELSE left(piece, length(piece) - length(raw)) END, '' ORDER BY o.i) AS kept FROM o LEFT JOIN r USING (id, i) GROUP BY 1)
SELECT id, regexp_replace(regexp_replace(regexp_replace(kept, '[ \\t]{{2,}}', ' ', 'g'), '\\n[ \\t]*\\n(?:[ \\t]*\\n)+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS answer FROM k""")
def chk14_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers less every third claim, cut out by its place; headings and sources stay."""
    rows = cited_answers(spark, sf_dir)
    rejected = claims.claim_spans(rows, "id", "answer").where("(id + n) % 3 = 0")
    return claims.filtered_answers(rows, "id", "answer", rejected)


def shadow_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: a metric is a hundredth of a number made from keys, the candidate's off by up to 2 hundredths."""
    k = F.col("o_orderkey")
    names = ("recall_at_5", "ndcg_at_10", "evidence_coverage", "page_coverage", "recall_at_10")
    pairs = [c for i, m in enumerate(names) for c in (((90 + (k + i) % 11) / 100).alias(f"b_{m}"), ((90 + (k + i) % 11 + (F.col("o_custkey") + i) % 5 - 2) / 100).alias(f"c_{m}"))]
    return table(spark, sf_dir, "orders").select((k % 4 != 0).alias("answerable"), F.col("o_orderpriority").alias("language"), F.array((F.col("o_custkey") % 40).cast("string"), F.col("o_orderstatus")).alias("scope"), *pairs)


_METRICS = ("recall_at_5", "ndcg_at_10", "evidence_coverage", "page_coverage", "recall_at_10")
_PAIRS = ", ".join(f"(90 + (o_orderkey + {i}) % 11) / 100 AS b_{m}, (90 + (o_orderkey + {i}) % 11 + (o_custkey + {i}) % 5 - 2) / 100 AS c_{m}" for i, m in enumerate(_METRICS))
_MEANS = ", ".join(f"avg(b_{m}) AS b_{m}, avg(c_{m}) AS c_{m}" for m in _METRICS)
_LOST = lambda cohort, name, ms: ", ".join(f"CASE WHEN cohort = '{cohort}' AND c_{m} - b_{m} < -0.01 - 1e-12 THEN {name} || '{m}' END" for m in ms)
_LOW = ", ".join(f"CASE WHEN cohort = '{c}' AND b_{m} < 0.9 THEN 'baseline_below_floor:{c}:{m}' END" for c in ("answerable", "no_answer_probe") for m in ("recall_at_10", "evidence_coverage"))
SHADOW = f"""WITH k AS (SELECT o_orderkey % 4 <> 0 AS answerable, o_orderpriority AS language, [(o_custkey % 40)::VARCHAR, o_orderstatus] AS scope, {_PAIRS} FROM orders),
x AS (SELECT CASE WHEN answerable THEN 'answerable' ELSE 'no_answer_probe' END AS cohort, NULL AS dimension, NULL AS value, * FROM k UNION ALL SELECT 'slice', 'language', language, * FROM k WHERE answerable UNION ALL SELECT 'slice', 'scope', unnest(scope), * FROM k WHERE answerable),
m AS (SELECT cohort, dimension, value, count(*) AS n, {_MEANS} FROM x GROUP BY 1, 2, 3), t AS (SELECT max(n) AS of FROM m WHERE cohort = 'answerable'),
f AS (SELECT m.*, of, list_filter([{_LOW}, {_LOST("answerable", "'overall_regression:'", _METRICS[:4])}, {_LOST("no_answer_probe", "'no_answer_probe_regression:'", _METRICS[:4])}, CASE WHEN cohort = 'slice' AND n < 20 THEN 'insufficient_slice:' || dimension || ':' || value END] ||
 CASE WHEN n >= 20 THEN [{_LOST("slice", "'slice_regression:' || dimension || ':' || value || ':'", _METRICS[:2])}] ELSE [] END, lambda c: c IS NOT NULL) AS codes FROM m, t)"""


@query("gat3_shadow_decision", f"""{SHADOW} SELECT len(flatten(list(codes))) = 0 AS accepted, bool_or(cohort = 'answerable' AND greatest(c_recall_at_5 - b_recall_at_5, c_ndcg_at_10 - b_ndcg_at_10) > 1e-12) AS improved, list_sort(flatten(list(codes))) AS failure_codes,
count(*) FILTER (WHERE cohort = 'slice' AND n >= 20) AS checked_slices, count(*) FILTER (WHERE cohort = 'slice' AND n >= 20 AND n <= greatest(5, ceil(of * 0.1))) AS rare_slices FROM f""")
def gat3_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate holds in the whole, among the probes and in every slice of 20 cases."""
    return decisions.shadow_decision(shadow_cases(spark, sf_dir), ["language", "scope"], decisions.ShadowPolicy(floor=0.9, enough=20))


@query("gat6_full_answer_checks", """WITH c AS (SELECT o_orderkey AS case_id, o_orderkey % 13 AS k FROM orders),
f AS (SELECT case_id, list_sort(list_filter([CASE k WHEN 0 THEN 'gold_binding' WHEN 1 THEN 'retrieval_snapshot' WHEN 2 THEN 'scope' WHEN 3 THEN 'exact_quote' WHEN 4 THEN 'evidence_coverage' WHEN 5 THEN 'answerability' WHEN 6 THEN 'number_unit' WHEN 7 THEN 'retrieval_snapshot' WHEN 8 THEN 'exact_quote' WHEN 9 THEN 'number_unit' WHEN 12 THEN 'evidence_coverage' END,
 CASE WHEN k = 5 THEN 'number_unit' WHEN k = 7 THEN 'exact_quote' END], lambda x: x IS NOT NULL)) AS failures FROM c) SELECT case_id, failures, len(failures) = 0 AS passed FROM f""")
def gat6_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks on answers about orders: bindings, the stored chunks, scopes, quotes, citations, abstention and quantities."""
    k, key = F.col("o_orderkey") % 13, F.col("o_orderkey").cast("string")
    lone = k.isin(11, 12)  # cases without an answer; 12 cites all the same
    quote = F.concat(F.lit("flow of "), (F.col("o_custkey") % 50).cast("string"), F.lit(".5 m3/h"))
    first, second = F.concat(F.lit("Order "), key, F.lit(": "), quote, F.lit(" at pump")), F.concat(F.lit("Order "), key, F.lit(" in general"))
    binding = lambda who: F.struct(F.concat(F.lit("case "), F.when((k == 0) & F.lit(who == 2), F.lit("other")).otherwise(key)).alias("case_id"), F.lit("scope").alias("scope_id"), F.sha2(key, 256).alias("sha256"))
    chunk = lambda i, t: F.struct(F.lit(i).alias("chunk_id"), F.when((k == 1) & F.lit(i == 2), "moved").otherwise("doc").alias("document_id"), t.alias("text"))
    found = lambda i: F.struct(F.lit(i).alias("chunk_id"), F.lit("doc").alias("document_id"), F.lit("ref").alias("document_ref"))
    value = F.concat((F.col("o_custkey") % 50).cast("string"), F.lit(".5"))
    exact = F.struct(F.lit(1).alias("chunk_id"), quote.alias("quote"), F.sha2(F.when(k == 8, "else").otherwise(quote), 256).alias("content_sha256"), F.sha2(F.when(k == 3, second).otherwise(first), 256).alias("text_sha256"))
    told = F.concat(F.lit("It is a "), quote).cast("string")
    answer = F.when(lone, "There is  insufficient\nevidence for this.").when(k == 5, "Insufficient evidence.").when(k == 6, F.concat(told, F.lit(" and 77 bar"))).otherwise(told)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("scope-sha256:"), F.sha2(F.lit("owner"), 256)).alias("scope_id"), (~lone).alias("answerable"), answer.alias("answer"), F.lit(True).alias("gold_review"),
        F.array(binding(1), binding(2), binding(3)).alias("bindings"), F.array(found(1), found(2)).alias("retrieved"), F.when(k == 7, F.array(chunk(1, first))).otherwise(F.array(chunk(1, first), chunk(2, second))).alias("chunks"),
        F.when(lone, F.array()).otherwise(F.array(exact)).alias("exact"), F.array(*(F.struct(F.lit(i).alias("chunk_id"), F.sha2(t, 256).alias("content_sha256")) for i, t in ((1, first), (2, second)))).alias("probe"),
        F.when((k == 4) | (k == 11), F.array().cast("array<int>")).when(k == 12, F.array(F.lit(2))).otherwise(F.array(F.lit(1))).alias("cited"), F.array(F.lit("ref")).alias("document_refs"), F.when(k == 2, F.array(F.lit("owner"), F.lit("another"))).otherwise(F.array(F.lit("owner"))).alias("owners"),
        F.when(lone, F.array()).otherwise(F.array(F.struct(F.when(k == 9, "1").otherwise(value).alias("value"), F.lit("m3/h").alias("unit")))).alias("expected"), F.array(F.struct(value.alias("value"), F.lit("m3/h").alias("unit"))).alias("supported"),
    )
    return decisions.answer_checks(rows)


STRUCTURE = """WITH d AS (SELECT doc_id, lang, coalesce(length(text), 0) AS n FROM documents),
e AS (SELECT lang AS language, unnest(['documents', 'pages', 'heading_edges', 'order_pairs', 'downstream_cases', 'text_continuation', 'table_continuation', 'image_association']) AS kind,
 unnest([1, 1 + n // 1000, n // 300, n // 200, doc_id % 2, doc_id % 3 // 2, doc_id % 11 // 10, 0]) AS n FROM d),
w AS (SELECT language, kind, least, 'insufficient_' || CASE WHEN kind LIKE '%tion' THEN 'relations:' || language || ':' || kind ELSE kind || ':' || language END AS code FROM (VALUES ('en'), ('de'), ('xx')) l(language), (VALUES ('documents', 1), ('pages', 5), ('heading_edges', 10), ('order_pairs', 20), ('downstream_cases', 20), ('text_continuation', 3), ('table_continuation', 3), ('image_association', 3)) k(kind, least)),
i AS (SELECT code FROM w WHERE coalesce((SELECT sum(n) FROM e WHERE e.language = w.language AND e.kind = w.kind), 0) < least
 UNION ALL SELECT 'insufficient_relations:' || kind FROM (VALUES ('text_continuation'), ('table_continuation'), ('image_association')) k(kind) WHERE coalesce((SELECT sum(n) FROM e WHERE e.kind = k.kind), 0) < 10),
s AS (SELECT k.kind, o_orderpriority AS scope, k.metric, avg(o_orderkey % k.m) / k.m AS baseline, avg((o_orderkey + o_custkey % 2) % k.m) / k.m AS candidate FROM orders, (VALUES ('structure', 'heading_f1', 7), ('structure', 'order_score', 5), ('downstream', 'recall_at_5', 3)) k(kind, metric, m) GROUP BY 1, 2, 3, k.m),
g AS (SELECT max(candidate - baseline) FILTER (WHERE kind = 'structure') AS best FROM s),
f AS (SELECT code FROM i UNION ALL SELECT kind || '_regression:' || scope || ':' || metric FROM s WHERE CASE WHEN kind = 'structure' THEN candidate - baseline < -0.005 ELSE candidate < baseline - 0.01 END
 UNION ALL SELECT 'no_material_structure_gain' FROM g WHERE best < 0.01 UNION ALL SELECT 'candidate_mapping_invalid' WHERE EXISTS (SELECT 1 FROM documents WHERE text IS NULL OR text = '')
 UNION ALL SELECT 'latency_budget_exceeded' FROM events HAVING max(value) FILTER (WHERE event_id % 2 = 1) > 2 * max(value) FILTER (WHERE event_id % 2 = 0) UNION ALL SELECT 'memory_budget_exceeded' FROM events HAVING max(user_id) > 36000)"""


@query("gat4_full_structure_gate", f"{STRUCTURE} SELECT (SELECT count(*) FROM i) = 0 AS eligible, count(*) = 0 AS accepted, list_sort(list(DISTINCT code)) AS failure_codes, round((SELECT best FROM g), 9) AS best_gain FROM f")
def gat4_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence counted from documents, scores by order priority, runtimes from events: the decision on all of it."""
    n, doc = F.coalesce(F.char_length("text"), F.lit(0)), F.col("doc_id")
    counts = {"documents": F.lit(1), "pages": 1 + F.floor(n / 1000), "heading_edges": F.floor(n / 300), "order_pairs": F.floor(n / 200), "downstream_cases": doc % 2, "text_continuation": F.floor(doc % 3 / 2), "table_continuation": F.floor(doc % 11 / 10), "image_association": F.lit(0)}
    docs = table(spark, sf_dir, "documents")
    evidence = docs.select(F.col("lang").alias("language"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("n")) for k, v in counts.items()))).alias("e")).select("language", "e.*")
    key, other = F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") % 2
    kinds = (("structure", "heading_f1", 7), ("structure", "order_score", 5), ("downstream", "recall_at_5", 3))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("metric"), (key % d).alias("b"), (other % d).alias("c"), F.lit(d).alias("d")) for k, m, d in kinds))).alias("s")
    scores = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), each).groupBy("s.kind", "scope", "s.metric", "s.d").agg(F.avg("s.b").alias("b"), F.avg("s.c").alias("c"))
    scores = scores.select("kind", "scope", "metric", (F.col("b") / F.col("d")).alias("baseline"), (F.col("c") / F.col("d")).alias("candidate"))
    validity = docs.agg(F.count_if(F.coalesce("text", F.lit("")) == "").alias("n")).select(F.lit("candidate_mapping").alias("name"), (F.col("n") == 0).alias("ok"))
    side = lambda k: F.max(F.when(F.col("event_id") % 2 == k, F.col("value")))
    runtime = table(spark, sf_dir, "events").agg(side(0).alias("b_p95"), side(1).alias("c_p95"), F.max("user_id").cast("double").alias("c_memory_mib"))
    found = decisions.structure_gate(evidence, scores, validity, runtime, decisions.StructurePolicy(languages=("en", "de", "xx")))
    return found.withColumn("best_gain", F.round("best_gain", 9))


PREFLIGHT = """WITH g AS (SELECT label, vec_id % 3 AS v, count(*) AS n, count(embedding) AS e, coalesce(bool_and(len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0), TRUE) AS finite, max(len(embedding)) AS size FROM embeddings GROUP BY 1, 2)
SELECT label, v, list_filter([CASE WHEN label = 0 THEN 'incomplete_run' END, CASE WHEN label = 1 THEN 'unexpected_version:schema' END, CASE WHEN e <> n THEN 'vectors_missing' END, CASE WHEN NOT finite THEN 'vectors_not_finite' END, CASE WHEN size IS DISTINCT FROM 64 THEN 'unexpected_vector_type' END,
 CASE WHEN label = 2 THEN 'index_invalid' END, CASE WHEN label IN (3, 4) THEN 'unsafe_role' END, CASE WHEN label = 5 THEN 'owner_probe_failed' END, CASE WHEN label = 6 THEN 'corpus_changed' END, CASE WHEN label = 7 THEN 'exact_search_used_index' END, CASE WHEN label = 8 THEN 'index_not_usable_in_every_scope' END,
 CASE WHEN label = 9 THEN 'measures_not_finite' END, CASE WHEN label <> 9 AND v = 1 THEN 'recall_below_limit' END, CASE WHEN label <> 9 AND v = 1 THEN 'fill_below_limit' END, CASE WHEN label <> 9 AND v = 1 THEN 'p95_regressed' END, CASE WHEN label <> 9 AND v = 1 THEN 'no_recall_gain' END,
 CASE WHEN v = 2 THEN 'scope_violated' END, CASE WHEN v = 2 THEN 'index_never_chosen' END], lambda x: x IS NOT NULL) AS reasons FROM g"""


@query("gat5_full_preflight", f"SELECT label, v, reasons, CASE WHEN len(reasons) = 0 THEN 'requires_full_comparison' ELSE 'no_go' END AS decision FROM ({PREFLIGHT})")
def gat5_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preflight for every label's vectors in three runs: the vectors' state from the table, one fault of the database a label, measures by run."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    state = table(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 3).alias("v")).agg(F.count("*").alias("rows"), F.count("embedding").alias("embedded"), F.coalesce(F.bool_and(finite), F.lit(True)).alias("finite"), F.concat(F.lit("vector("), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).cast("string"), F.lit(")")).alias("vector_type"))
    label, v = F.col("label"), F.col("v")
    bad = lambda n: (label == n).cast("int")
    state = state.withColumns({
        "complete": label != 0, "schema": F.when(label == 1, "old").otherwise("new"), "index_valid": label != 2, "row_security": label != 3, "bypasses": label == 4, "owns": F.lit(False), "leaks": bad(5), "stable": label != 6, "exact_used_index": bad(7),
        "coverage": F.when(label == 8, 0.5).otherwise(1.0), "natural_coverage": F.when(v == 2, 0.0).otherwise(0.3), "recall": F.when(label == 9, float("nan")).when(v == 1, 0.98).otherwise(0.995), "plain_recall": F.lit(0.979), "fill": F.when(v == 1, 0.98).otherwise(1.0),
        "exact_p95": F.lit(100.0), "p95": F.when(v == 1, 106.0).otherwise(104.0), "violations": (v == 2).cast("int"),
    })
    return decisions.preflight(state, decisions.PreflightPolicy({"schema": "new"}, "vector(64)")).select("label", "v", "reasons", "decision")
