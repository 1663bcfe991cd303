"""Queries: quantities, entities, text forms, joins by containment, reranking pieces, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, quantities, text
from ..operators import matching, vector
from .registry import query, table
from .retrieval import COSINE, VECTORS
from .views import CHUNKS_SQL, MEMORY_SQL, as_sql, chunks, memory

C, M = f"WITH {CHUNKS_SQL} ", f"WITH {MEMORY_SQL} "

#: An answer and its evidence for every event, with quantities whose values are known by construction.
ANSWERS = {
    "case_id": "event_id", "e": "event_id", "u": "user_id",
    "answer": "concat('Flow ', event_id % 50, ',5 m³/h at ', user_id % 40, ' bar', case when event_id % 3 = 0 then concat(' and +0', user_id, '.50 кг [', event_id % 12, ']') else ' for 7 days' end)",
    "evidence": "concat('pressure ', (user_id + event_id % 2) % 40, ' bar; flow ', event_id % 50, '.5 m3/h; mass ', user_id, '.5 kg')",
}
A = f"WITH {as_sql('ans', ANSWERS, 'events')} "
MENTIONED = "list_concat([(e % 50) || '.5|m3/h', (u % 40) || '|bar'], CASE WHEN e % 3 = 0 THEN [u || '.5|kg'] ELSE ['7|?'] END)"
SUPPORTED = "[((u + e % 2) % 40) || '|bar', (e % 50) || '.5|m3/h', u || '.5|kg']"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{x} as {c}" for c, x in ANSWERS.items()))


@query("num4_quantity_mentions", A + f"SELECT case_id, {MENTIONED} AS mentions FROM ans")
def num4(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.transform(quantities.mentions(F.col("answer")), lambda m: F.concat_ws("|", m["value"], F.coalesce(m["unit"], F.lit("?"))))
    return answers(spark, sf_dir).select("case_id", spelled.alias("mentions"))


GUARD = f"""g AS (SELECT case_id, e, len(m) AS mentioned, len(list_filter(m, lambda x: NOT list_contains(s, x))) AS unsupported_pairs, len(list_filter(m, lambda x: NOT list_contains(list_transform(s, lambda y: split_part(y, '|', 1)), split_part(x, '|', 1)))) AS unsupported_values,
  len(list_filter(m, lambda x: x LIKE '%|?')) AS invalid_units FROM (SELECT case_id, e, {MENTIONED} AS m, {SUPPORTED} AS s FROM ans))"""


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("case_id", "e", quantities.support(F.col("answer"), F.col("evidence")).alias("s")).select("case_id", "e", "s.*")


@query("num10_quantity_support", f"{A}, {GUARD} SELECT case_id, mentioned, unsupported_pairs, unsupported_values, invalid_units, round(unsupported_pairs / mentioned, 6) AS unsupported_rate FROM g")
def num10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir).drop("e").withColumn("unsupported_rate", F.round("unsupported_rate", 6))


@query("met7_quantity_metrics", A + f""", m AS (SELECT case_id, {MENTIONED} AS m, list_concat([(e % 50) || '.5|m3/h'], CASE WHEN e % 2 = 0 THEN [u || '.5|kg'] ELSE [] END) AS x, {SUPPORTED} AS s FROM ans)
SELECT case_id, len(list_filter(x, lambda q: list_contains(m, q))) AS matched, len(x) AS expected, round(len(list_filter(x, lambda q: list_contains(m, q))) / len(x), 6) AS recall, (len(list_filter(x, lambda q: list_contains(m, q))) = len(x) AND len(list_filter(m, lambda q: NOT list_contains(s, q))) = 0)::INT AS accuracy FROM m""")
def met7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the expected quantities as a multiset, and whether all are there with none unsupported."""
    rows = answers(spark, sf_dir)
    key = lambda arr: F.transform(F.filter(arr, lambda m: m["unit"].isNotNull()), lambda m: F.concat_ws("|", m["value"], m["unit"]))
    expected = F.when(F.col("e") % 2 == 0, F.concat(F.lit("flow "), F.col("e") % 50, F.lit(".5 m3/h, mass "), F.col("u"), F.lit(".5 kg"))).otherwise(F.concat(F.lit("flow "), F.col("e") % 50, F.lit(".5 m3/h")))
    want, got = key(quantities.mentions(expected)), key(quantities.mentions(F.col("answer")))
    missing = F.size(numbers.multiset_difference(want, got))
    loose = quantities.support(F.col("answer"), F.col("evidence"))["unsupported_pairs"]
    n = F.size(want)
    return rows.select("case_id", (n - missing).alias("matched"), n.alias("expected"), F.round((n - missing) / n, 6).alias("recall"), ((missing == 0) & (loose == 0)).cast("int").alias("accuracy"))


#: Texts with one entity of every kind.
SPEC = {"id": "o_orderkey", "n": "o_custkey", "spec": "concat('Use x=', o_custkey, 'a per ISO ', 9000 + o_orderkey % 50, ' at ', o_orderkey % 90, ' kPa, item ', o_custkey % 70, '.')"}
E = f"WITH {as_sql('sp', SPEC, 'orders')} "
FOUND = "['formula:x=' || n || 'a', 'standard:ISO ' || (9000 + id % 50), 'measurement:' || (id % 90) || ' kPa', 'number:' || (n % 70)]"


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{x} as {c}" for c, x in SPEC.items()))


@query("num7_entity_spans", E + f"SELECT id, {FOUND} AS found, [4, 12 + length('' || n), 24 + length('' || n), 35 + length('' || n) + length('' || (id % 90))] AS starts FROM sp")
def num7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = specs(spark, sf_dir).select("id", quantities.entities(F.col("spec")).alias("e"))
    return rows.select("id", F.transform("e", lambda x: F.concat_ws(":", x["kind"], x["value"])).alias("found"), F.transform("e", lambda x: x["start"]).alias("starts"))


@query("num8_protected_entities", E + "SELECT id, 'Use ⟪E_0⟫ per ⟪E_1⟫ at ⟪E_2⟫, item ⟪E_3⟫.' AS protected, TRUE AS restored, CASE WHEN id % 2 = 0 THEN ['⟪E_3⟫'] ELSE [] END AS missing, CASE WHEN id % 2 = 0 THEN ['⟪E_9⟫'] ELSE [] END AS unknown FROM sp")
def num8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities replaced by tokens and put back; every other translation changes a token's number."""
    rows = specs(spark, sf_dir).withColumn("values", F.transform(quantities.entities(F.col("spec")), lambda e: e["value"])).withColumn("protected", quantities.protected(F.col("spec")))
    translated = F.when(F.col("id") % 2 == 0, F.replace("protected", F.lit("⟪E_3⟫"), F.lit("⟪E_9⟫"))).otherwise(F.col("protected"))
    problems = quantities.token_problems(translated, F.col("values"))
    return rows.select("id", "protected", (quantities.restored(F.col("protected"), F.col("values")) == F.col("spec")).alias("restored"), problems["missing"].alias("missing"), problems["unknown"].alias("unknown"))


@query("num9_unconfirmed_entities", E + "SELECT id, CASE WHEN id % 90 = 5 THEN [] ELSE ['measurement:' || (id % 90) || ' kPa'] END AS unconfirmed FROM sp")
def num9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a translation that gives every pressure as 5 kPa doesn't confirm."""
    translated = F.regexp_replace("spec", "[0-9]+ kPa", "5 kPa")
    return specs(spark, sf_dir).select("id", quantities.unconfirmed(F.col("spec"), translated).alias("unconfirmed"))


@query("scn1_entity_counts", E + f"SELECT split_part(k, ':', 1) AS kind, count(*) AS n FROM (SELECT unnest({FOUND}) AS k FROM sp) GROUP BY 1")
def scn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs(spark, sf_dir).select(F.explode(quantities.entities(F.col("spec"))).alias("e")).groupBy(F.col("e")["kind"].alias("kind")).agg(F.count("*").alias("n"))


@query("num1_canonical_numbers", A + "SELECT case_id, [ltrim((e % 50) || '.5', '0'), '3', (u % 40)::VARCHAR] || CASE WHEN e % 3 = 0 THEN [ltrim(u || '.5', '0'), (e % 12)::VARCHAR] ELSE ['7'] END AS found FROM ans")
def num1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of the answers; the exponent of m3 counts as one where it is written as a digit."""
    rows = answers(spark, sf_dir).withColumn("answer", F.replace("answer", F.lit("m³"), F.lit("m 3 ")))
    return rows.select("case_id", F.transform(numbers.numbers(F.col("answer")), lambda x: F.regexp_replace(x, r"^\+", "")).alias("found"))


@query("num3_units", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'm3/h' WHEN 2 THEN '' WHEN 3 THEN 'degC' WHEN 4 THEN NULL ELSE 'kPa' END AS unit FROM part")
def num3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(x) for x in ("кг", "м³/ч", " ", "℃", "furlong", "кПа"))), (F.col("p_size") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.normalized_unit(raw).alias("unit"))


@query("num5_number_validation", A + "SELECT case_id, CASE WHEN e % 3 = 0 THEN [] ELSE ['7'] END AS missing FROM ans")
def num5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a translation without its clause on days lacks."""
    return answers(spark, sf_dir).select("case_id", numbers.missing_numbers(F.col("answer"), F.replace("answer", F.lit(" for 7 days"), F.lit(""))).alias("missing"))


@query("num6_standards", E + "SELECT id, [(9000 + id % 50)::VARCHAR] AS standards, CASE WHEN id % 2 = 0 THEN [(9000 + id % 50)::VARCHAR] ELSE [] END AS missing FROM sp")
def num6(spark: SparkSession, sf_dir: str) -> DataFrame:
    translated = F.when(F.col("id") % 2 == 1, F.col("spec"))
    return specs(spark, sf_dir).select("id", numbers.standards(F.col("spec")).alias("standards"), numbers.missing_standards(F.col("spec"), translated).alias("missing"))


@query("num11_half_rules", "SELECT l_orderkey, l_linenumber, round(l_quantity / 2.0) AS half_up, round_even(l_quantity / 2.0, 0) AS half_even FROM lineitem")
def num11(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("l_quantity") / 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(half).alias("half_up"), F.bround(half).alias("half_even"))


@F.pandas_udf(T.StringType())
def nfc(values):
    return values.str.normalize("NFC")


@query("str4_content_hash", "SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS h FROM documents")
def str4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(nfc(lines), 256).alias("h"))


FORMS = "SELECT doc_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^0-9a-zA-Zа-яА-ЯёЁ]+', ' ', 'g')), ' +', ' ', 'g')) AS matched, coalesce(regexp_matches(text, '^[ ]*8[.) ]'), FALSE) AS chapter_8, "
FORMS += "contains(lower(coalesce(text, '')), 'nicht die') AS abstains, CASE WHEN trim(coalesce(text, '')) = '' THEN '.' ELSE left(trim(text), 8000) END AS body, 'scope-sha256:' || sha256(coalesce(source, '')) AS scope_id, 'ev-sha256:' || sha256(coalesce(text, '')) || ':p' || (doc_id % 9) || ':text' AS evidence_id FROM documents"


@query("str6_15_text_forms", FORMS)
def str6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for matching (letters and digits only), heading numbers, abstention marks, input of an embedding, ids."""
    whole = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.match_form(whole).alias("matched"), F.coalesce(text.has_heading_number(F.col("text"), "8"), F.lit(False)).alias("chapter_8"), text.has_marker(whole, ["nicht die"]).alias("abstains"),
        text.embedding_input(F.col("text"), 8000).alias("body"), text.scope_id(F.coalesce("source", F.lit(""))).alias("scope_id"), text.evidence_id(F.sha2(whole, 256), F.col("doc_id") % 9, F.lit("text")).alias("evidence_id"),
    )


@query("str7_document_language", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[一-鿿]') THEN 'zh' WHEN regexp_matches(coalesce(text, ''), '[Ѐ-ӿ]') THEN 'ru' ELSE 'en' END AS lang FROM documents")
def str7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language by counts of scripts; the tables hold Latin script alone, so that any sign of another decides."""
    return table(spark, sf_dir, "documents").select("doc_id", text.document_language(F.coalesce("text", F.lit(""))).alias("lang"))


GLOSSARY = """terms AS (SELECT item_id AS term_id, string_split(text, ' ')[1] AS term FROM benchmark WHERE length(string_split(text, ' ')[1]) > 1)"""


@query("jn13_glossary_terms", f"""WITH {GLOSSARY}, p AS (SELECT doc_id AS id, term_id, term, lower(text) AS low, lower(term) AS t, instr(lower(text), lower(term)) AS pos FROM documents, terms WHERE contains(lower(text), lower(term)))
SELECT * FROM (SELECT id, term_id, term, row_number() OVER (PARTITION BY id ORDER BY term_id) AS place FROM p WHERE (pos = 1 OR NOT regexp_matches(substr(low, pos - 1, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(low, pos + length(t), 1), '[\\p{{L}}\\p{{N}}]')) WHERE place <= 10""")
def jn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms (the first word of every benchmark item) in documents."""
    first = F.element_at(F.split("text", " "), 1)
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), first.alias("term")).where(F.char_length("term") > 1)
    return matching.glossary_terms(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), terms)


@query("jn5_lateral_terms", "SELECT i.item_id, t.term, t.n FROM benchmark i, LATERAL (SELECT term, count(*) AS n FROM (SELECT unnest(string_split(i.text, ' ')) AS term) GROUP BY 1) t")
def jn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of every query with their numbers."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query("jn16_binding_problems", """WITH a AS (SELECT doc_id % 900 AS k, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id AS k, count(*) AS m FROM labels GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN n IS NULL THEN 'no_record' WHEN m IS NULL THEN 'no_partner' WHEN n > 1 OR m > 1 THEN 'not_unique' END AS problem FROM a FULL JOIN b ON a.k = b.k) WHERE problem IS NOT NULL""")
def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select((F.col("doc_id") % 900).alias("doc_id"))
    return matching.binding_problems(records, table(spark, sf_dir, "labels"), "doc_id")


@query("jn17_positional_binding", """WITH d AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, o_orderstatus AS kind, o_orderpriority AS path FROM orders),
c AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS kind, o_orderpriority AS path FROM orders WHERE o_orderkey % 301 <> 0)
SELECT coalesce(d.doc, c.doc) AS doc, coalesce(d.idx, c.idx) AS idx, CASE WHEN c.doc IS NULL THEN 'no_chunk' WHEN d.doc IS NULL THEN 'no_draft' WHEN d.kind <> c.kind OR d.path <> c.path THEN 'differs' ELSE 'bound' END AS state FROM d FULL JOIN c ON d.doc = c.doc AND d.idx = c.idx""")
def jn17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt chunks bound to stored ones by document and place; kind and path must agree."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders")
    cols = lambda kind: [F.col("o_custkey").alias("doc"), place.cast("long").alias("idx"), F.struct(kind.alias("kind"), F.col("o_orderpriority").alias("path"))]
    drafts = rows.select(*cols(F.col("o_orderstatus"))[:2], cols(F.col("o_orderstatus"))[2].alias("draft"))
    stored = rows.where("o_orderkey % 301 <> 0")
    changed = cols(F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")))
    both = drafts.join(stored.select(*changed[:2], changed[2].alias("chunk")), ["doc", "idx"], "full")
    state = F.when(F.col("chunk").isNull(), "no_chunk").when(F.col("draft").isNull(), "no_draft").when(F.col("draft") != F.col("chunk"), "differs").otherwise("bound")
    return both.select("doc", "idx", state.alias("state"))


@query("jn18_evidence_matches", C + """, l AS (SELECT id AS locator_id, document_id, greatest(page_start - 1, 0) AS a, page_end + 1 AS b, [substr(text, 1, 30), substr(text, 5, 25)] AS anchors FROM chunks WHERE id % 25 = 0 AND text IS NOT NULL)
SELECT DISTINCT locator_id, c.id FROM l JOIN chunks c ON c.document_id = l.document_id AND c.page_start <= l.b AND c.page_end >= l.a AND (contains(c.text, anchors[1]) OR contains(c.text, anchors[2]))""")
def jn18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    anchors = F.array(F.substring("text", 1, 30), F.substring("text", 5, 25)).alias("anchors")
    locators = rows.where("id % 25 = 0 and text is not null").select(F.col("id").alias("locator_id"), "document_id", F.greatest(F.col("page_start") - 1, F.lit(0)).alias("page_start"), (F.col("page_end") + 1).alias("page_end"), anchors)
    return matching.evidence_matches(rows, locators)


@query("vec5_page_recall", f"WITH {VECTORS}, d AS (SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS distance FROM v q, v WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, round(1 - distance, 6) AS vscore, rank FROM r WHERE rank <= 10")
def vec5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector.nearest(rows, rows.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round(1 - F.col("distance"), 6).alias("vscore"), "rank")


@query("fus2_memory_fusion", M + """, d AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, id) AS rank FROM memory), s AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY length(content) DESC, id) AS rank FROM memory),
f AS (SELECT user_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM d WHERE rank <= 20 UNION ALL SELECT * FROM s WHERE rank <= 20) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS place FROM f) WHERE place <= 12""")
def fus2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's memories by two orders of 20, fused with k = 60; the 12 best, ties by id."""
    rows = memory(spark, sf_dir)

    def best(*order) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where("rank <= 20").select("user_id", "id", "rank")

    lists = best(F.desc("relevance"), "id").unionByName(best(F.desc(F.char_length("content")), "id"))
    fused = lists.groupBy("user_id", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "id"))).where("place <= 12")


@query("rrk2_4_rerank_payload", "SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE 'T ' || text END, ''), text) AS chosen, left(text, 2000) AS query, left(coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE 'T ' || text END, ''), text), 4000) AS document FROM conversations")
def rrk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation where there is one, else the text; both sides cut to a reranker's limits."""
    chosen = F.coalesce(F.nullif(F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("T "), "text")), F.lit("")), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chosen.alias("chosen"), F.substring("text", 1, 2000).alias("query"), F.substring(chosen, 1, 4000).alias("document"))


@query("rrk3_visual_augment", C + """, r AS (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY n_chars DESC, id) AS rank FROM chunks), have AS (SELECT document_id, id FROM r WHERE rank <= 5),
i AS (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY page_start, id) AS p FROM chunks WHERE kind = 'image' AND page_start % 2 = 0 AND NOT EXISTS (SELECT 1 FROM have WHERE have.id = chunks.id))
SELECT document_id, id, 'text' AS why FROM have UNION ALL SELECT document_id, id, 'visual' FROM i WHERE p <= 3""")
def rrk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's five first results and up to three image chunks of recalled pages that aren't among them."""
    rows = chunks(spark, sf_dir)
    top = lambda *o: F.row_number().over(Window.partitionBy("document_id").orderBy(*o))
    have = rows.withColumn("r", top(F.desc("n_chars"), "id")).where("r <= 5").select("document_id", "id")
    images = rows.where("kind = 'image' and page_start % 2 = 0").join(have.select("id"), "id", "left_anti").withColumn("r", top("page_start", "id")).where("r <= 3")
    return have.withColumn("why", F.lit("text")).unionByName(images.select("document_id", "id", F.lit("visual").alias("why")))


@query("rrk5_frozen_scores", """WITH p AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations), s AS (SELECT sha256(text) AS h, max((conv_id * 7 + turn * 3) % 100 / 100.0) AS score FROM conversations WHERE conv_id % 9 <> 0 GROUP BY 1),
j AS (SELECT conv_id, turn, score FROM p LEFT JOIN s USING (h)), c AS (SELECT conv_id, max(score) AS top, count(*) FILTER (WHERE score IS NULL) AS missed FROM j GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC NULLS LAST, turn) AS rank FROM j)
SELECT r.conv_id, r.turn, round(r.score, 6) AS score, r.rank FROM r JOIN c USING (conv_id) WHERE missed = 0 AND top >= 0.5 AND rank <= 3""")
def rrk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns ranked by frozen scores of their texts; a conversation with a text that has none, or without a score of 0.5, has no results."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    frozen = table(spark, sf_dir, "conversations").where("conv_id % 9 <> 0").groupBy(F.sha2("text", 256).alias("h")).agg(F.max((F.col("conv_id") * 7 + F.col("turn") * 3) % 100 / 100).alias("score"))
    scored = rows.join(frozen, "h", "left")
    sound = scored.groupBy("conv_id").agg(F.max("score").alias("top"), F.count_if(F.col("score").isNull()).alias("missed")).where("missed = 0 and top >= 0.5").select("conv_id")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn"))
    return scored.join(sound, "conv_id").withColumn("rank", rank).where("rank <= 3").select("conv_id", "turn", F.round("score", 6).alias("score"), "rank")


@query("rrk6_capped_evidence", C + """, e AS (SELECT owner, id, min(step) AS step FROM (SELECT owner, id, id % 3 AS step FROM chunks WHERE id % 20 < 12 UNION ALL SELECT owner, id, 3 FROM chunks WHERE id % 20 > 9) GROUP BY 1, 2),
n AS (SELECT owner, count(*) AS n FROM e GROUP BY 1), r AS (SELECT e.*, n, row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN n > 12 THEN -((id * 7) % 101) ELSE step END, id) AS place FROM e JOIN n USING (owner))
SELECT owner, id, place FROM r WHERE place <= 12""")
def rrk6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of several searches' evidence; reranked and cut where it exceeds 12."""
    rows = chunks(spark, sf_dir)
    found = rows.where("id % 20 < 12").select("owner", "id", (F.col("id") % 3).alias("step")).unionByName(rows.where("id % 20 > 9").select("owner", "id", F.lit(3).cast("long").alias("step")))
    once = found.groupBy("owner", "id").agg(F.min("step").alias("step"))
    sized = once.join(once.groupBy("owner").agg(F.count("*").alias("n")), "owner")
    order = F.when(F.col("n") > 12, -((F.col("id") * 7) % 101)).otherwise(F.col("step"))
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(order, "id"))).where("place <= 12").select("owner", "id", "place")


@query("ord5_greedy_fill")
def ord5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that fit in 300 characters: the first and those with digits always, then by words shared with the language's name of "the"."""
    units = F.filter(F.transform(F.split("text", "\n"), lambda u: F.trim(u)), lambda u: u != "")
    terms = F.array(*(F.lit(w) for w in ("the", "of", "la", "de", "und", "in")))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", units.alias("units")).where("size(units) > 0")
    scores = F.transform("units", lambda u: F.size(F.array_intersect(F.split(F.lower(u), " "), terms)))
    must = F.filter(F.transform("units", lambda u, i: F.when((i == 0) | u.rlike("[0-9]"), i).otherwise(-1)), lambda i: i >= 0)
    return rows.select("doc_id", matching.greedy_fill(F.col("units"), scores, must, 300).alias("kept"))


@query("arr1_3_array_forms", "SELECT conv_id, list(turn || '=' || role ORDER BY turn) AS zipped, list_distinct(list(role ORDER BY turn)).list_sort() AS roles, bool_and(role IN ('user', 'assistant')) AS subset FROM conversations GROUP BY 1")
def arr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays combined by place, without repeats, and tested for being a subset."""
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    turns, roles = F.col("t.turn"), F.col("t.role")
    zipped = F.zip_with(turns, roles, lambda a, b: F.concat_ws("=", a, b))
    known = F.array(F.lit("user"), F.lit("assistant"))
    return listed.select("conv_id", zipped.alias("zipped"), F.array_sort(F.array_distinct(roles)).alias("roles"), (F.size(F.array_except(roles, known)) == 0).alias("subset"))


@query("jsn1_number_of_key", "SELECT event_id, try_cast(nullif(json_extract_string(props, '$.k'), '7') AS INT) AS k, try_cast(event_type AS INT) AS none FROM events")
def jsn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.nullif(F.get_json_object("props", "$.k"), F.lit("7")).try_cast("int").alias("k"), F.col("event_type").try_cast("int").alias("none"))


@query("jsn3_merged_table_parts", """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS x, NULL::VARCHAR AS y FROM lineitem WHERE l_orderkey % 10 = 1), b AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN l_linestatus WHEN l_partkey % 2 = 1 THEN l_returnflag END AS x, l_linestatus AS y FROM lineitem WHERE l_orderkey % 10 = 1)
SELECT a.k, a.n, CASE WHEN a.x <> b.x THEN NULL ELSE coalesce(a.x, b.x) END AS x, coalesce(a.y, b.y) AS y, coalesce(a.x <> b.x, FALSE) AS conflict FROM a JOIN b ON a.k = b.k AND a.n = b.n""")
def jsn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of a table joined on their anchors: of every field the value that isn't empty; two that differ are a conflict."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey", "l_returnflag", "l_linestatus")
    a = rows.select("k", "n", F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("ax"))
    b = rows.select("k", "n", F.when(F.col("l_partkey") % 3 == 0, F.col("l_linestatus")).when(F.col("l_partkey") % 2 == 1, F.col("l_returnflag")).alias("bx"), F.col("l_linestatus").alias("y"))
    conflict = F.coalesce(F.col("ax") != F.col("bx"), F.lit(False))
    return a.join(b, ["k", "n"]).select("k", "n", F.when(~conflict, F.coalesce("ax", "bx")).alias("x"), "y", conflict.alias("conflict"))


@query("jsn4_merged_values", """SELECT o_orderkey, {'a': coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderpriority), 'b': {'c': coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, -1)}} AS merged FROM orders""")
def jsn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values merged field by field, the left one first."""
    left = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("a"), F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("c")).alias("b"))
    right = F.struct(F.col("o_orderpriority").alias("a"), F.struct(F.lit(-1).cast("long").alias("c")).alias("b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", left.alias("l"), right.alias("r"))
    return rows.select("o_orderkey", F.struct(F.coalesce("l.a", "r.a").alias("a"), F.struct(F.coalesce("l.b.c", "r.b.c").alias("c")).alias("b")).alias("merged"))


@query("jsn5_graph_problems", """WITH e AS (SELECT o_custkey AS g, o_orderkey AS s, o_orderkey + CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE 1 END AS t FROM orders), n AS (SELECT o_custkey AS g, o_orderkey AS id FROM orders)
SELECT e.g, count(*) AS edges, count(*) FILTER (WHERE n.id IS NULL) AS unknown_targets, count(*) FILTER (WHERE s = t) AS self_edges FROM e LEFT JOIN n ON n.g = e.g AND n.id = e.t GROUP BY 1""")
def jsn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a diagram whose target is no node of it, or their own source."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("s"))
    edges = rows.withColumn("t", F.col("s") + F.when(F.col("s") % 40 == 0, 0).otherwise(1))
    nodes = rows.select("g", F.col("s").alias("t"), F.lit(1).alias("known"))
    return edges.join(nodes, ["g", "t"], "left").groupBy("g").agg(F.count("*").alias("edges"), F.count_if(F.col("known").isNull()).alias("unknown_targets"), F.count_if(F.col("s") == F.col("t")).alias("self_edges"))


@query("snk4_audit_events", "SELECT event_id AS id, 'u' || user_id AS actor, event_type AS action, CASE WHEN user_id % 2 = 0 THEN 'document' END AS object_type, json_extract_string(props, '$.k') AS detail, ts FROM events WHERE event_type <> 'view' UNION ALL SELECT max(event_id) + 1, 'system', 'append', NULL, NULL, max(ts) FROM events")
def snk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log with one more event appended."""
    rows = table(spark, sf_dir, "events")
    cols = (F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_type").alias("action"), F.when(F.col("user_id") % 2 == 0, "document").alias("object_type"), F.get_json_object("props", "$.k").alias("detail"), "ts")
    one = rows.agg((F.max("event_id") + 1).alias("id"), F.max("ts").alias("ts")).select("id", F.lit("system").alias("actor"), F.lit("append").alias("action"), F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("string").alias("detail"), "ts")
    return rows.where("event_type <> 'view'").select(*cols).unionByName(one)


@query("snk8_injected_translations", "WITH t AS (SELECT text, min('T' || doc_id) AS translated FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL GROUP BY 1) SELECT d.doc_id, coalesce(t.translated, d.text) AS text, t.translated IS NOT NULL AS injected FROM documents d LEFT JOIN t ON t.text = d.text")
def snk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replaced by the translation of an equal text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 3 = 0 and text is not null").groupBy("text").agg(F.min(F.concat(F.lit("T"), "doc_id")).alias("translated"))
    return docs.join(known, "text", "left").select("doc_id", F.coalesce("translated", "text").alias("text"), F.col("translated").isNotNull().alias("injected"))


@query("stm12_parse_claims", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = o_orderkey % 3 AND (o_orderstatus IN ('O', 'P') OR o_orderpriority LIKE '1%') THEN 'parsing' ELSE o_orderstatus END AS status, o_custkey % 3 = o_orderkey % 3 AND (o_orderstatus IN ('O', 'P') OR o_orderpriority LIKE '1%') AS claimed FROM orders""")
def stm12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose revision is the claimed one go to parsing, unless they are in a final state."""
    mine = (F.col("o_custkey") % 3 == F.col("o_orderkey") % 3) & (F.col("o_orderstatus").isin("O", "P") | F.col("o_orderpriority").startswith("1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(mine, "parsing").otherwise(F.col("o_orderstatus")).alias("status"), mine.alias("claimed"))


@query("stm8_purge_and_export", M + "SELECT id, CASE WHEN user_id = 'u4' THEN 'export' ELSE 'keep' END AS part, CASE WHEN user_id = 'u4' THEN content END AS content FROM memory WHERE user_id = 'u4' OR user_id <> 'u4'")
def stm8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's erasure: what is exported to the user, and the table that stays without it."""
    rows = memory(spark, sf_dir)
    export = rows.where("user_id = 'u4'").select("id", F.lit("export").alias("part"), "content")
    return export.unionByName(rows.where("user_id <> 'u4'").select("id", F.lit("keep").alias("part"), F.lit(None).cast("string").alias("content")))


@query("src13_candidate_columns", "SELECT page_id, url, length(html) AS n FROM pages")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns of a candidate corpus; no others are read."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.char_length("html").cast("long").alias("n"))


WORDS = "list_filter(list_distinct(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')), lambda x: length(x) >= 3)"


@query("smp4_cross_document_pairs", f"""WITH r AS (SELECT doc_id AS id, source AS document_id, doc_id % 7 AS owner, {WORDS} AS w FROM documents)
SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS shared, round(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)), 6) AS score FROM r a JOIN r b ON a.owner = b.owner AND a.id < b.id AND a.document_id <> b.document_id AND len(a.w) > 0 AND len(b.w) > 0 WHERE len(list_intersect(a.w, b.w)) >= 2 AND round(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)), 6) >= 0.8""")
def smp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), (F.col("doc_id") % 7).alias("owner"), "text")
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.char_length(w) >= 3)
    return matching.similar_pairs(rows, 0.8, words)


@query("smp7_language_schedule", "SELECT o_orderkey AS slot, ['ru', 'en', 'zh'][1 + (o_orderkey + 2) % 3] AS lang, list_transform(range(0, 4), lambda i: (o_orderkey + i) % 4) AS sources FROM orders")
def smp7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot's language, whose counts differ by one at most, and its order of sources for retries."""
    slot = F.col("o_orderkey")
    lang = F.element_at(F.array(F.lit("ru"), F.lit("en"), F.lit("zh")), (1 + (slot + 2) % 3).cast("int"))
    return table(spark, sf_dir, "orders").select(slot.alias("slot"), lang.alias("lang"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (slot + i) % 4).alias("sources"))


@query("smp8_content_types", C + """SELECT id, CASE WHEN kind = 'table' THEN 'table' WHEN kind = 'image' THEN CASE WHEN status = 'error' THEN 'scan' ELSE 'figure' END WHEN regexp_matches(text, '[=∑√]') THEN 'formula' WHEN status = 'error' THEN 'scan' ELSE 'text' END AS content_type,
list_filter([CASE WHEN regexp_matches(text, '[0-9]') THEN 'numbers' END, CASE WHEN regexp_matches(text, '[0-9] ?(mm|kg|bar)') THEN 'units' END, CASE WHEN regexp_matches(text, '(ISO|DIN) ?[0-9]') THEN 'standards' END], lambda x: x IS NOT NULL) AS tags FROM chunks""")
def smp8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chunk holds and what is hard about it."""
    t, scan = F.col("text"), F.col("status") == "error"
    kind = F.when(F.col("kind") == "table", "table").when(F.col("kind") == "image", F.when(scan, "scan").otherwise("figure")).when(t.rlike("[=∑√]"), "formula").when(scan, "scan").otherwise("text")
    tags = F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(n)) for p, n in (("[0-9]", "numbers"), ("[0-9] ?(mm|kg|bar)", "units"), ("(ISO|DIN) ?[0-9]", "standards")))))
    return chunks(spark, sf_dir).select("id", kind.alias("content_type"), tags.alias("tags"))


@query("smp11_quota_selection")
def smp11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers for quotas of market segments, no nation twice; no shortage where the nations suffice."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").cast("string").alias("group"))
    quotas = {s: 4 for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    chosen, _ = matching.quota_selection(rows, quotas, "seed")
    return spark.createDataFrame(chosen, "stratum string, id string, group string")


@query("smp12_quota_capacity", "SELECT c_mktsegment AS stratum, count(DISTINCT c_nationkey) AS groups, greatest(30 - count(DISTINCT c_nationkey), 0) AS shortage FROM customer GROUP BY 1")
def smp12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct groups of every stratum, and what a quota of 30 lacks."""
    groups = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), "c_nationkey").distinct().groupBy("stratum").agg(F.count("*").alias("groups"))
    return groups.withColumn("shortage", F.greatest(30 - F.col("groups"), F.lit(0)))


@query("smp15_translation_pairs", "SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN text ELSE 'T ' || text END AS translated FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND text IS NOT NULL ORDER BY doc_id LIMIT 200")
def smp15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 pairs of a text and a translation that differs from it."""
    rows = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0 and text is not null").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("T "), "text")).alias("translated"))
    return rows.where("translated <> text").orderBy("doc_id").limit(200)


@query("smp16_gold_containment", "SELECT conv_id, turn, contains(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), CASE WHEN turn % 2 = 0 THEN 'in die' ELSE 'the of' END) AS matched FROM conversations")
def smp16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer holds its gold text, case and white space aside."""
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.contains(F.when(F.col("turn") % 2 == 0, "in die").otherwise("the of")).alias("matched"))


@query("smp17_citation_chips", "WITH c AS (SELECT o_custkey AS answer, o_orderkey AS place, o_orderpriority AS filename, o_orderkey % 2 AS page, [o_orderkey % 5, 9] AS segs FROM orders), u AS (SELECT answer, filename, page, unnest(segs) AS s FROM c) SELECT c.answer, c.filename, c.page, min(place) AS place, (SELECT list_sort(list(DISTINCT s)) FROM u WHERE u.answer = c.answer AND u.filename = c.filename AND u.page = c.page) AS segments FROM c GROUP BY 1, 2, 3")
def smp17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of an answer by file and page, the first one's place and the segments of all."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("answer"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("filename"), (F.col("o_orderkey") % 2).alias("page"), F.array(F.col("o_orderkey") % 5, F.lit(9).cast("long")).alias("segs"))
    return rows.groupBy("answer", "filename", "page").agg(F.min("place").alias("place"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("segs")))).alias("segments"))


@query("smp21_translation_decision", A + "SELECT case_id, CASE WHEN e % 4 = 0 THEN CASE WHEN e % 3 = 0 THEN 'memory' ELSE CASE WHEN e % 5 = 0 THEN 'retry' ELSE 'flagged' END END ELSE 'model' END AS decision FROM ans")
def smp21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact translation is taken from memory if no number is missing in it; else one retry, whose result is kept if sound and flagged if not."""
    stored, again = F.replace("answer", F.lit(" for 7 days"), F.lit("")), F.when(F.col("e") % 5 == 0, F.col("answer")).otherwise(F.lit(""))
    sound = lambda t: F.size(numbers.missing_numbers(F.col("answer"), t)) == 0
    decision = F.when(F.col("e") % 4 != 0, "model").when(sound(stored), "memory").when(sound(again), "retry").otherwise("flagged")
    return answers(spark, sf_dir).select("case_id", decision.alias("decision"))


@query("scn1_text_entities")
def scn1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every kind in all documents, by source."""
    rows = table(spark, sf_dir, "documents").select("source", F.explode(quantities.entities(F.col("text"))).alias("e"))
    return rows.groupBy("source", F.col("e")["kind"].alias("kind")).agg(F.count("*").alias("n"), F.count_distinct(F.col("e")["value"]).alias("values"))
