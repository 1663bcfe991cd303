"""Queries: parsed pages and their segments, over documents as segments of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, pages
from .registry import query, table
from .views import as_sql

#: Segments of parsed documents: a source is a document, pages hold about 100 ids.
SEGMENTS = {
    "document_id": "source",
    "idx": "doc_id",
    "kind": "case doc_id % 12 when 0 then 'heading' when 5 then 'table' when 7 then 'image' when 9 then 'equation' else 'paragraph' end",
    "heading_level": "case when doc_id % 12 = 0 then 1 + cast(floor(doc_id / 12) as bigint) % 3 end",
    "page_idx": "case when doc_id % 97 = 5 then -1 when doc_id % 89 = 3 then null else cast(floor(doc_id / 100) as bigint) end",
    "source_text": "text",
    "translated": "case doc_id % 4 when 0 then null when 1 then text else upper(text) end",
    "x0": "(doc_id * 7) % 100",
    "y0": "(doc_id * 3) % 100",
    "x1": "(doc_id * 11) % 120",
    "y1": "(doc_id * 13) % 120",
}
SEGMENTS_SQL = as_sql("seg", SEGMENTS, "documents")
S = f"WITH {SEGMENTS_SQL} "
W = "[ \\t\\n\\r\\f\\x0B]+"


def plain(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{W}', ' ', 'g'))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} as {c}" for c, e in SEGMENTS.items()))


DEGENERATE = f"""b AS (SELECT *, replace(t, ' ', '') AS body, string_split(lower(t), ' ') AS words FROM (SELECT *, {plain("source_text")} AS t FROM seg)),
x AS (SELECT b.* EXCLUDE (words, body), length(t) >= 40 AND (length(t) > 8000 OR len(words) >= 60 AND len(list_distinct(words)) < 0.35 * len(words)
  OR list_max(list_transform(list_distinct(string_split(left(body, 8000), '')), lambda c: length(body) - length(replace(body, c, '')))) > 0.8 * length(body)) AS degenerate FROM b)"""


@query("flt17_degenerate_segments", f"{S}, {DEGENERATE} SELECT idx, coalesce(degenerate, FALSE) AS degenerate FROM x")
def flt17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("idx", F.coalesce(pages.degenerate(F.col("source_text")), F.lit(False)).alias("degenerate"))


@query("flt20_needs_translation", "SELECT doc_id, coalesce(regexp_matches(text, '[A-Za-z]') AND doc_id % 3 <> 0 OR regexp_matches(text, '[А-Яа-яЁё]') AND doc_id % 3 <> 1 OR regexp_matches(text, '[一-鿿]') AND doc_id % 3 <> 2, FALSE) AS needed FROM documents")
def flt20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with letters of another script than the target's (0: en, 1: ru, 2: zh, by id)."""
    scripts = ("[A-Za-z]", "[А-Яа-яЁё]", "[一-鿿]")
    needed = F.lit(False)
    for i, script in enumerate(scripts):
        needed = needed | (F.col("text").rlike(script) & (F.col("doc_id") % 3 != i))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(needed, F.lit(False)).alias("needed"))


@query("geo1_valid_boxes", f"{S} SELECT idx, x1 > x0 AND y1 > y0 AS valid, x1 > x0 AND y1 > y0 AND x1 <= 100 AND y1 <= 110 AS on_page FROM seg")
def geo1(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return segments(spark, sf_dir).select("idx", pages.valid_box(*box).alias("valid"), pages.valid_box(*box, F.lit(100), F.lit(110)).alias("on_page"))


QUALITY = f"""seg2 AS (SELECT *, 1 + (kind = 'table')::INT AS checked, (NOT (x1 > x0 AND y1 > y0))::INT AS broken, {plain("source_text")} AS t FROM seg),
sizes AS (SELECT document_id, max(page_idx) + 2 AS n_pages FROM seg GROUP BY 1), native AS (SELECT document_id, sum(length({plain("source_text")})) FILTER (WHERE idx % 3 = 0) AS native_chars FROM seg GROUP BY 1),
pg AS (SELECT document_id, page_idx, n_pages, sum(length(t)) AS chars, bool_or(kind IN ('image', 'table', 'equation')) AS structured, count(*) AS n, sum(broken) AS broken, sum(checked) AS checked FROM seg2 JOIN sizes USING (document_id) GROUP BY 1, 2, 3),
pd AS (SELECT document_id, n_pages, sum(n) AS n, count(*) FILTER (WHERE page_idx BETWEEN 0 AND n_pages - 1) AS covered, coalesce(sum(n) FILTER (WHERE page_idx < 0 OR page_idx >= n_pages), 0) AS invalid,
  count(*) FILTER (WHERE page_idx BETWEEN 0 AND n_pages - 1 AND (chars > 0 OR structured)) AS content, count(*) FILTER (WHERE page_idx BETWEEN 0 AND n_pages - 1 AND chars > 0) AS texts,
  coalesce(sum(chars) FILTER (WHERE page_idx BETWEEN 0 AND n_pages - 1), 0) AS chars, sum(broken) AS broken, sum(checked) AS checked FROM pg GROUP BY 1, 2),
du AS (SELECT document_id, sum(length(t) * (c - 1)) / sum(length(t) * c) AS duplicates FROM (SELECT document_id, t, count(*) AS c FROM seg2 WHERE length(t) >= 20 GROUP BY 1, 2) GROUP BY 1),
q1 AS (SELECT pd.*, coalesce(duplicates, 0) AS duplicates, coalesce(native_chars, 0) AS native_chars, covered / n_pages AS pc, content / n_pages AS cc, least(1.0, chars / (40 * greatest(texts, 1))) AS de,
  (1 - broken / checked) * CASE WHEN invalid > 0 THEN greatest(0.0, 1 - invalid / greatest(n, 1)) ELSE 1 END AS it FROM pd LEFT JOIN du USING (document_id) LEFT JOIN native USING (document_id)),
q2 AS (SELECT *, CASE WHEN native_chars > 0 THEN least(1.0, chars / native_chars) END AS nc FROM q1),
quality AS (SELECT document_id, round(0.35 * pc + 0.10 * cc + 0.25 * coalesce((de + nc) / 2, de) + 0.15 * (1 - duplicates) + 0.15 * it, 4) AS score, round(pc, 4) AS page_coverage, round(duplicates, 4) AS duplicate_ratio, round(it, 4) AS integrity_ratio, round(nc, 4) AS native_text_coverage,
  list_filter([CASE WHEN pc < 1 THEN 'missing_pages' END, CASE WHEN invalid > 0 THEN 'invalid_page_indices' END, CASE WHEN cc < 1 THEN 'pages_without_content' END, CASE WHEN de < 0.5 THEN 'sparse_text' END,
    CASE WHEN duplicates > 0.25 THEN 'duplicate_content' END, CASE WHEN broken > 0 THEN 'invalid_structures' END, CASE WHEN nc < 0.5 THEN 'low_native_text_coverage' END], lambda x: x IS NOT NULL) AS reasons FROM q2)"""


@query("agg10_parse_quality", f"{S}, {QUALITY} SELECT *, score >= 0.7 AND len(list_filter(reasons, lambda x: x <> 'sparse_text')) = 0 AS acceptable FROM quality")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_quality(segments(spark, sf_dir))


def parse_quality(rows: DataFrame) -> DataFrame:
    box = pages.valid_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    rows = rows.withColumns({"checked": 1 + (F.col("kind") == "table").cast("int"), "broken": (~box).cast("int")})
    sizes = rows.groupBy("document_id").agg((F.max("page_idx") + 2).alias("n_pages"))
    native = rows.groupBy("document_id").agg(F.sum(F.when(F.col("idx") % 3 == 0, F.char_length(pages.plain(F.col("source_text"))))).alias("native_chars"))
    return pages.parse_quality(rows, sizes, native)


@query("agg11_doubled_characters", f"""{S}, l AS (SELECT document_id, regexp_replace(lower(coalesce(source_text, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS l FROM seg),
c AS (SELECT document_id, greatest(length(l) - 1, 0) AS pairs, list_sum(list_transform(range(1, length(l)), lambda i: (substr(l, i, 1) = substr(l, i + 1, 1))::INT)) AS same FROM l)
SELECT document_id, CASE WHEN sum(pairs) > 0 THEN round(coalesce(sum(same), 0) / sum(pairs), 6) ELSE 0.0 END AS ratio FROM c GROUP BY 1""")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.doubled_characters(segments(spark, sf_dir))


FEATURES = {
    "document_id": "source", "page_idx": "doc_id", "images": "doc_id % 3", "tables": "cast(floor(doc_id / 3) as bigint) % 2", "equations": "case when doc_id % 7 = 0 then 1 else 0 end", "texts": "doc_id % 5",
    "parsed_chars": "case when doc_id % 11 = 0 then 0 else n_chars end", "native_chars": "case when doc_id % 2 = 0 then 0 else n_chars % 100 end", "fields": "case when doc_id % 13 = 0 then 4 else 0 end", "marks": "case when doc_id % 17 = 0 then 1 else 0 end",
    "form": "doc_id % 34 = 0", "chart": "doc_id % 4 = 1", "diagram": "doc_id % 6 = 1", "raw_score": "(doc_id % 10) / 10.0", "backfilled": "doc_id % 8 = 3", "explicit": "doc_id % 19 = 0",
}
TYPES = f"""{as_sql("pf", FEATURES, "documents")},
ty AS (SELECT *, CASE WHEN form AND fields + marks >= 1 OR fields >= 4 OR marks >= 3 THEN 'form' WHEN images > 0 AND chart AND diagram THEN 'mixed' WHEN images > 0 AND chart THEN 'chart' WHEN images > 0 AND diagram THEN 'diagram'
  WHEN (images > 0)::INT + (tables > 0)::INT + (equations > 0)::INT >= 2 AND (texts > 0 OR parsed_chars >= 80) THEN 'mixed' WHEN tables > 0 THEN 'table' WHEN equations > 0 AND texts > 0 THEN 'mixed' WHEN images > 0 AND (texts > 0 OR parsed_chars >= 80) THEN 'mixed'
  WHEN native_chars < 20 AND parsed_chars >= 40 AND images = 0 THEN 'scan' WHEN parsed_chars >= 40 OR native_chars >= 40 THEN 'text' ELSE 'unknown' END AS page_type,
  CASE WHEN form AND fields + marks >= 1 OR fields >= 4 OR marks >= 3 THEN 0.92 WHEN images > 0 AND chart AND diagram THEN 0.78 WHEN images > 0 AND (chart OR diagram) THEN 0.9
  WHEN (images > 0)::INT + (tables > 0)::INT + (equations > 0)::INT >= 2 AND (texts > 0 OR parsed_chars >= 80) THEN 0.78 WHEN tables > 0 THEN 0.9 WHEN equations > 0 AND texts > 0 THEN 0.72 WHEN images > 0 AND (texts > 0 OR parsed_chars >= 80) THEN 0.7
  WHEN native_chars < 20 AND parsed_chars >= 40 AND images = 0 THEN 0.8 WHEN parsed_chars >= 40 AND native_chars > 0 THEN 0.85 WHEN parsed_chars >= 40 THEN 0.75 WHEN native_chars >= 40 THEN 0.65 ELSE 0.0 END::DOUBLE AS confidence FROM pf),
ro AS (SELECT *, CASE WHEN explicit THEN 'primary' WHEN page_type = 'form' THEN 'structured_extraction' WHEN page_type = 'chart' THEN 'chart_extraction' WHEN page_type = 'diagram' THEN 'diagram_extraction' WHEN page_type = 'table' OR raw_score < 0.7 OR backfilled THEN 'parser_fallback' ELSE 'primary' END AS role,
  CASE WHEN explicit THEN 'explicit_backend' WHEN page_type = 'form' THEN 'form_requires_schema_extraction' WHEN page_type = 'chart' THEN 'chart_requires_data_extraction' WHEN page_type = 'diagram' THEN 'diagram_requires_structured_representation' WHEN page_type = 'table' THEN 'table_requires_structure_check'
  WHEN raw_score < 0.7 THEN 'low_raw_score' WHEN backfilled THEN 'backfilled_primary' ELSE 'primary_acceptable' END AS reason FROM ty),
pl AS (SELECT document_id, page_idx, role, reason, row_number() OVER (PARTITION BY document_id ORDER BY list_position(['structured_extraction', 'chart_extraction', 'diagram_extraction', 'parser_fallback'], role), page_idx) AS place FROM ro WHERE role <> 'primary')"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} as {c}" for c, e in FEATURES.items()))


@query("chk17_page_types", f"WITH {TYPES} SELECT page_idx, page_type, confidence FROM ty")
def chk17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_types(features(spark, sf_dir)).select("page_idx", "page_type", "confidence")


@query("chk18_page_routes", f"WITH {TYPES} SELECT page_idx, role, reason FROM ro")
def chk18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_routes(pages.page_types(features(spark, sf_dir))).select("page_idx", "role", "reason")


@query("smp14_routing_plan", f"WITH {TYPES} SELECT * FROM pl WHERE place <= 5")
def smp14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.routing_plan(pages.page_routes(pages.page_types(features(spark, sf_dir))).select("document_id", "page_idx", "role", "reason"), 5)


@query("agg37_routing_histogram", f"""WITH {TYPES}, long AS (SELECT document_id, unnest(['type:' || page_type, 'role:' || role, 'reason:' || reason]) AS k FROM ro),
h AS (SELECT document_id, list_sort(list(k || '=' || c)) AS counts FROM (SELECT document_id, k, count(*) AS c FROM long GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT document_id, count(*) AS page_count, count(*) FILTER (WHERE confidence < 0.7) AS low_confidence, count(*) FILTER (WHERE role <> 'primary') AS eligible FROM ro GROUP BY 1)
SELECT t.*, least(eligible, 5) AS selected, greatest(eligible - 5, 0) AS truncated, counts FROM t JOIN h USING (document_id)""")
def agg37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document by type, role and reason; of those to route 5 are selected."""
    routes = pages.page_routes(pages.page_types(features(spark, sf_dir)))
    keys = F.explode(F.array(*(F.concat(F.lit(f"{n}:"), F.col(c)) for n, c in (("type", "page_type"), ("role", "role"), ("reason", "reason")))))
    counts = routes.select("document_id", keys.alias("k")).groupBy("document_id", "k").count().groupBy("document_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "k", "count"))).alias("counts"))
    totals = routes.groupBy("document_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("confidence") < 0.7).alias("low_confidence"), F.count_if(F.col("role") != "primary").alias("eligible"))
    return totals.withColumns({"selected": F.least("eligible", F.lit(5)), "truncated": F.greatest(F.col("eligible") - 5, F.lit(0))}).join(counts, "document_id")


@query("chk8_paragraphs", """WITH l AS (SELECT doc_id, ln, i FROM (SELECT doc_id, unnest(lines) AS ln, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents))),
g AS (SELECT *, sum((i = 1 OR regexp_matches(ln, '^(Th|La|Der|[0-9]+[.])'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l)
SELECT doc_id, p - 1 AS paragraph, string_agg(ln, ' ' ORDER BY i) AS text FROM g GROUP BY 1, 2""")
def chk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every text; words that begin a sentence stand for the numbers of clauses."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages.paragraphs(F.col("text"), r"^(Th|La|Der|[0-9]+[.])")).alias("paragraph", "text"))
    return rows.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "text")


#: Texts as pages: with a page number before, as contents with leaders, or with clauses of three kinds at the beginnings of some lines.
PAGE_TEXT = """CASE doc_id % 4 WHEN 0 THEN 'xii' || chr(10) || text WHEN 1 THEN regexp_replace(text, '([^\n])(\n|$)', '\\1 .... 17' || '\\2', 'g') WHEN 2 THEN regexp_replace(text, '\n([a-zA-Z])', chr(10) || '3.1 ' || '\\1', 'g') ELSE 'Scope: of it' || chr(10) || '(a) ' || coalesce(text, '') || chr(13) || chr(10) || 'Scope:' END"""


@query("chk8_page_paragraphs", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce({PAGE_TEXT}, ''), chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
t AS (SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches(x, '[.…]{{3,}}\\s*\\d+\\s*$'))) >= greatest(3, len(ls) * 0.4) AS contents, CASE WHEN regexp_full_match(lower(ls[1]), '[ivxlcdm0-9]{{1,6}}') THEN ls[2:] ELSE ls END AS body, ls FROM l),
u AS (SELECT doc_id, unnest(body) AS ln, generate_subscripts(body, 1) AS i FROM t WHERE NOT contents),
g AS (SELECT *, sum((i > 1 AND regexp_matches(ln, '^\\s*([0-9]+\\.([0-9]+)*\\s|\\([a-z0-9]{{1,4}}\\)\\s|[A-Z][A-Za-z ]{{1,28}}:\\s)'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM u)
SELECT doc_id, p::BIGINT AS paragraph, string_agg(ln, ' ' ORDER BY i) AS text FROM g GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, list_aggregate(list_transform(ls, lambda x: regexp_replace(x, '[.…]{{2,}}', ' … ', 'g')), 'string_agg', chr(10)) FROM t WHERE contents""")
def chk8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages: page numbers stripped, contents kept line by line, clauses apart."""
    k, text = F.col("doc_id") % 4, F.col("text")
    page = F.when(k == 0, F.concat(F.lit("xii\n"), text)).when(k == 1, F.regexp_replace(text, r"([^\n])(\n|\z)", "$1 .... 17$2")).when(k == 2, F.regexp_replace(text, r"\n([a-zA-Z])", "\n3.1 $1"))
    page = F.when(k == 3, F.concat(F.lit("Scope: of it\n(a) "), F.coalesce(text, F.lit("")), F.lit("\r\nScope:"))).otherwise(page)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages.page_paragraphs(page, None)).alias("paragraph", "text"))
    return rows.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "text")


@query("chk9_capped_paragraphs")
def chk9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in parts of at most 1800 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages.capped(F.col("text"), 1800)).alias("part", "text"))


KEY = "regexp_replace(lower(coalesce({0}, '')), '[^0-9a-zа-яё]', '', 'g')"


@query("chk10_backfilled_pages", f"""{S}, v AS (SELECT * FROM seg WHERE idx % 3 = 0 AND page_idx IS NOT NULL), la AS (SELECT document_id, page_idx, idx AS paragraph, source_text AS text FROM seg WHERE idx % 3 < 2 AND source_text IS NOT NULL AND page_idx IS NOT NULL),
z AS (SELECT document_id, page_idx, sum(length(text)) AS size FROM la GROUP BY 1, 2), g AS (SELECT document_id, page_idx, sum(length(coalesce(source_text, ''))) AS got FROM v GROUP BY 1, 2),
th AS (SELECT document_id, page_idx FROM z LEFT JOIN g USING (document_id, page_idx) WHERE size >= 200 AND coalesce(got, 0) < 0.6 * size), k AS (SELECT la.*, left({KEY.format("text")}, 48) AS k FROM la JOIN th USING (document_id, page_idx))
SELECT document_id, page_idx, paragraph, text FROM k WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM v WHERE v.document_id = k.document_id AND v.page_idx = k.page_idx AND contains({KEY.format("v.source_text")}, k.k))""")
def chk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parser that kept every third segment lacks of a text layer that has two of three."""
    rows = segments(spark, sf_dir).where("page_idx is not null")
    layer = rows.where("idx % 3 < 2 and source_text is not null").select("document_id", "page_idx", F.col("idx").alias("paragraph"), F.col("source_text").alias("text"))
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^0-9a-zа-яё]", "")
    return pages.backfilled(rows.where("idx % 3 = 0"), layer, key("source_text"), key("text"))


ITEMS = {
    "document_id": "source", "position": "doc_id", "type": "case doc_id % 8 when 0 then 'header' when 1 then 'footer' when 2 then 'table' when 3 then 'image' when 4 then 'equation' else 'text' end",
    "text": "case when doc_id % 24 = 0 then 'Running Head' when doc_id % 16 = 2 then null else text end", "text_level": "case when doc_id % 16 = 5 then 2 when doc_id % 16 = 6 then 0 end", "page_idx": "cast(floor(doc_id / 100) as bigint)", "caption": "case when doc_id % 3 = 0 then concat('Caption ', doc_id) end",
}


@query("chk11_content_segments", f"""WITH {as_sql("items", ITEMS, "documents")}, i AS (SELECT *, {plain("text")} AS tx FROM items), h AS (SELECT document_id, lower(tx) AS norm, count(*) AS times FROM i WHERE type = 'header' GROUP BY 1, 2),
k AS (SELECT i.*, CASE WHEN type = 'text' AND tx <> '' THEN CASE WHEN coalesce(text_level, 0) > 0 THEN 'heading' ELSE 'paragraph' END WHEN type = 'header' AND tx <> '' AND times = 1 THEN 'heading' WHEN type = 'table' AND (tx <> '' OR coalesce(caption, '') <> '') THEN 'table' WHEN type = 'image' THEN 'image' WHEN type = 'equation' AND tx <> '' THEN 'equation' END AS kind
  FROM i LEFT JOIN h ON h.document_id = i.document_id AND h.norm = lower(tx)),
seg AS (SELECT *, CASE WHEN type = 'image' THEN coalesce(caption, '') WHEN type = 'table' THEN trim(concat_ws(chr(10), caption, tx)) ELSE tx END AS source_text, CASE WHEN type = 'header' THEN 1 WHEN type = 'text' AND text_level > 0 THEN text_level END AS heading_level FROM k WHERE kind IS NOT NULL), {DEGENERATE}
SELECT document_id, position, kind, source_text, heading_level, page_idx, type = 'header' AS title FROM x WHERE NOT (kind IN ('paragraph', 'table') AND coalesce(degenerate, FALSE))""")
def chk11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.content_segments(table(spark, sf_dir, "documents").selectExpr(*(f"{e} as {c}" for c, e in ITEMS.items())))


@query("chk15_replaced_pages", f"""{S}, p AS (SELECT document_id, page_idx, idx FROM seg WHERE idx % 2 = 0), c AS (SELECT document_id, page_idx, idx FROM seg WHERE idx % 2 = 1 AND page_idx % 3 = 1), m AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = p.document_id AND c.page_idx = p.page_idx) UNION ALL SELECT * FROM c)
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_idx NULLS LAST, idx) - 1 AS new_idx FROM m""")
def chk15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select("document_id", "page_idx", "idx")
    return pages.replaced_pages(rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1 and page_idx % 3 = 1"))


SCORES = {"page": "doc_id", "primary_score": "(doc_id % 10) / 10.0", "fallback_score": "case when doc_id % 7 = 0 then null else ((doc_id * 3) % 11) / 10.0 end", "primary_chars": "n_chars", "fallback_chars": "n_chars + doc_id % 5 - 1"}


@query("chk16_page_fallbacks", f"""WITH {as_sql("s", SCORES, "documents")}, r AS (SELECT page, CASE WHEN fallback_score IS NULL THEN 'no_candidate' WHEN fallback_score < 0.5 THEN 'below_minimum' WHEN round(fallback_score - primary_score, 9) < 0.1 THEN 'margin_not_met' WHEN fallback_chars < primary_chars THEN 'text_regression' ELSE 'better' END AS reason FROM s)
SELECT page, reason, CASE WHEN reason = 'better' THEN 'fallback' ELSE 'primary' END AS choice FROM r""")
def chk16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(*(f"{e} as {c}" for c, e in SCORES.items()))
    return pages.fallback_choice(rows, 0.5, 0.1).select("page", "reason", "choice")


@query("smp18_block_geometry", f"""{S}, k AS (SELECT *, lower({plain("source_text")}) AS norm FROM seg WHERE page_idx IS NOT NULL), b AS (SELECT document_id, page_idx, norm, max_by(x0, idx) AS x0, max_by(y0, idx) AS y0 FROM k WHERE idx % 2 = 0 GROUP BY 1, 2, 3),
ty AS (SELECT document_id, page_idx, kind, x0, y0, row_number() OVER (PARTITION BY document_id, page_idx, kind ORDER BY idx) AS n FROM seg WHERE idx % 2 = 0 AND kind IN ('table', 'image')), w AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_idx, kind ORDER BY idx) AS n FROM k WHERE idx % 2 = 1)
SELECT w.idx, CASE WHEN w.kind IN ('table', 'image') THEN ty.x0 ELSE b.x0 END AS x0, CASE WHEN w.kind IN ('table', 'image') THEN ty.y0 ELSE b.y0 END AS y0 FROM w LEFT JOIN b ON b.document_id = w.document_id AND b.page_idx = w.page_idx AND b.norm = w.norm LEFT JOIN ty ON ty.document_id = w.document_id AND ty.page_idx = w.page_idx AND ty.kind = w.kind AND ty.n = w.n""")
def smp18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes for segments: by page and text (the last block wins), tables and images in their order on the page."""
    rows = segments(spark, sf_dir).where("page_idx is not null").withColumn("norm", F.lower(pages.plain(F.col("source_text"))))
    place = F.row_number().over(Window.partitionBy("document_id", "page_idx", "kind").orderBy("idx"))
    blocks, wanted = rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1").withColumn("n", place)
    by_text = blocks.groupBy("document_id", "page_idx", "norm").agg(F.max_by(F.struct("x0", "y0"), "idx").alias("t"))
    typed = blocks.where("kind in ('table', 'image')").select("document_id", "page_idx", "kind", F.struct("x0", "y0").alias("o"), place.alias("n"))
    found = wanted.drop("x0", "y0").join(by_text, ["document_id", "page_idx", "norm"], "left").join(typed, ["document_id", "page_idx", "kind", "n"], "left")
    box = F.when(F.col("kind").isin("table", "image"), F.col("o")).otherwise(F.col("t"))
    return found.select("idx", box["x0"].alias("x0"), box["y0"].alias("y0"))


@query("smp19_reflowed_lists", """WITH l AS (SELECT conv_id, turn, (length(text) * 3) % 40 AS x0, text || (turn % 3) AS ln, turn % 5 <> 4 AS digit FROM conversations), k AS (SELECT conv_id, turn, CASE WHEN digit THEN ln ELSE ln || '.' END AS ln, round(x0 / 5) AS x FROM l),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(ln, '[0-9]$')) AS d FROM k GROUP BY 1), r AS (SELECT k.*, least(dense_rank() OVER (PARTITION BY conv_id ORDER BY x) - 1, 4) AS lv FROM k)
SELECT conv_id, string_agg(repeat('    ', lv::BIGINT) || ln, chr(10) ORDER BY turn) AS text FROM r JOIN g USING (conv_id) WHERE n >= 4 AND d >= 0.5 * n GROUP BY 1""")
def smp19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of four lines or more, half of which end in a digit, a line each, indented by clusters of their left edge."""
    text = F.concat(F.col("text"), (F.col("turn") % 3).cast("string"), F.when(F.col("turn") % 5 == 4, ".").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("ln"), F.round((F.char_length("text") * 3) % 40 / 5).alias("x"))
    level = F.least(F.dense_rank().over(Window.partitionBy("conv_id").orderBy("x")) - 1, F.lit(4))
    lists = rows.withColumn("lv", level).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "lv", "ln"))).alias("lines"))
    digits = F.size(F.filter("lines", lambda r: r["ln"].rlike("[0-9]$")))
    good = lists.where((F.size("lines") >= 4) & (digits >= 0.5 * F.size("lines")))
    return good.select("conv_id", F.array_join(F.transform("lines", lambda r: F.concat(F.repeat(F.lit("    "), r["lv"]), r["ln"])), "\n").alias("text"))


@query("smp20_translation_units", """WITH c AS (SELECT o_orderkey AS table_id, [o_orderstatus, o_orderpriority, '', o_orderstatus, (o_custkey % 4)::VARCHAR] AS cells FROM orders), u AS (SELECT table_id, unnest(cells) AS t, unnest(range(1, 6)) AS i FROM c), f AS (SELECT table_id, t, min(i) AS i FROM u WHERE t <> '' GROUP BY 1, 2)
SELECT table_id, list(t ORDER BY i) AS units FROM f GROUP BY 1""")
def smp20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts of a table's cells, in their order."""
    rows = F.array(F.array("o_orderstatus", "o_orderpriority", F.lit("")), F.array("o_orderstatus", (F.col("o_custkey") % 4).cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), F.array_distinct(F.array_remove(F.flatten(rows), "")).alias("units"))


@query("win4_ordinal_in_section", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal_in_section FROM orders")
def win4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a section's chunks by source position, then index: a customer's orders by date, then key."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(order) - 1).cast("long").alias("ordinal_in_section"))


@query("chk3_section_of_segment", """WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 + turn % 3 END AS level FROM conversations),
p AS (SELECT s.conv_id, s.turn, h.turn AS head, h.level FROM s JOIN s h ON h.conv_id = s.conv_id AND h.turn <= s.turn AND h.level IS NOT NULL),
k AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.conv_id = p.conv_id AND q.turn = p.turn AND q.head > p.head AND q.level <= p.level))
SELECT s.conv_id, s.turn, coalesce(list(k.head ORDER BY k.head) FILTER (WHERE k.head IS NOT NULL), []) AS section_path, coalesce('h' || max(k.head), 'root' || s.conv_id) AS section_id FROM s LEFT JOIN k ON k.conv_id = s.conv_id AND k.turn = s.turn GROUP BY s.conv_id, s.turn""")
def chk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings above every segment, the last of which is its section: a user's turn is a heading of level 1 to 3.

    Of each level the last heading counts while no later one of that level or a lower one stands between: running maxima by level, no fold.
    """
    level = F.when(F.col("role") == "user", 1 + F.col("turn") % 3)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda low, high: F.max(F.when(F.col("level").between(low, high), F.col("turn"))).over(so_far)
    heads = rows.withColumns({"a": last(1, 1), "b": last(2, 2), "c": last(3, 3)})
    second = F.when(F.col("b") > F.coalesce("a", F.lit(-1)), F.col("b"))
    third = F.when(F.col("c") > F.greatest(F.coalesce("a", F.lit(-1)), F.coalesce("b", F.lit(-1))), F.col("c"))
    path = F.array_compact(F.array(F.col("a"), second, third))
    section = F.coalesce(F.concat(F.lit("h"), F.try_element_at(path, F.lit(-1))), F.concat(F.lit("root"), "conv_id"))
    return heads.select("conv_id", "turn", path.alias("section_path"), section.alias("section_id"))


@query("chk14_filtered_answer", """WITH s AS (SELECT conv_id, turn, string_split(text, '. ') AS parts FROM conversations), u AS (SELECT conv_id, turn, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM s)
SELECT s.conv_id, s.turn, trim(coalesce(string_agg(p, '. ' ORDER BY i), '')) AS text FROM s LEFT JOIN (SELECT * FROM u WHERE length(p) % 3 <> 0) u ON u.conv_id = s.conv_id AND u.turn = s.turn GROUP BY 1, 2""")
def chk14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers less the sentences that are rejected (whose length is a multiple of three)."""
    kept = F.filter(F.split("text", r"\. "), lambda p: F.char_length(p) % 3 != 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.coalesce(F.array_join(kept, ". "), F.lit(""))).alias("text"))


@query("chk19_tree_problems", """WITH n AS (SELECT o_orderkey AS id, o_custkey AS tree, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN o_orderkey ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent, o_orderkey % 3 AS ordinal FROM orders)
SELECT n.tree, count(*) AS nodes, count(*) FILTER (WHERE n.parent IS NULL) <> 1 AS not_one_root, count(*) FILTER (WHERE n.parent = n.id) AS self_links, count(*) FILTER (WHERE p.tree <> n.tree) AS foreign_parents FROM n LEFT JOIN n p ON p.id = n.parent GROUP BY 1""")
def chk19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with trees of nodes: other than one root, nodes that are their own parent, parents of another tree."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    parent = F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_orderkey") % 50 == 1, F.col("o_orderkey")).otherwise(before))
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tree"), parent.alias("parent"))
    above = nodes.select(F.col("id").alias("parent"), F.col("tree").alias("parent_tree"))
    return nodes.join(above, "parent", "left").groupBy("tree").agg(F.count("*").alias("nodes"), (F.count_if(F.col("parent").isNull()) != 1).alias("not_one_root"), F.count_if(F.col("parent") == F.col("id")).alias("self_links"), F.count_if(F.col("parent_tree") != F.col("tree")).alias("foreign_parents"))


@query("chk1_section_chunks")
def chk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of conversations as documents: a system or user turn is a heading, every fifth turn an image, every seventh a table."""
    kind = F.when(F.col("turn") % 5 == 4, "image").when(F.col("turn") % 7 == 6, "table").when(F.col("role") == "user", "heading").otherwise("paragraph")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").cast("int").alias("idx"), kind.alias("kind"), (1 + F.col("turn") % 3).cast("int").alias("heading_level"),
        F.floor(F.col("turn") / 2).cast("int").alias("page_idx"), F.col("text").alias("source_text"), F.when(F.col("turn") % 2 == 0, F.upper("text")).alias("translated_text"), F.lit(None).cast("string").alias("image"),
    )
    return chunking.chunked(rows)


@query("chk7_bounded_parts")
def chk7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in parts of at most 400 characters, cut at blanks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.bounded_parts(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), 400)).alias("part", "text"))
