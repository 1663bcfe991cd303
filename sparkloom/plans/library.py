"""Queries: scopes, filters, projections, joins and aggregates over a document library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordered, scope
from .registry import query, table
from .views import CHUNKS_SQL, MEMORY_SQL, chunks, memory

C = f"WITH {CHUNKS_SQL} "
M = f"WITH {MEMORY_SQL} "


@query("src1_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("src2_key_lookup", "SELECT * FROM documents WHERE doc_id = 42")
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id = 42")


@query("src3_keyset_page", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 rows after id 100."""
    return table(spark, sf_dir, "documents").where("doc_id > 100").orderBy("doc_id").limit(50).select("doc_id", "lang", "n_chars")


@query("src4_unnest_with_ordinality", "SELECT vec_id, i AS ordinal, round(embedding[i]::DOUBLE, 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("ordinal"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("flt1_retrieval_scope", C + "SELECT id, document_id, folder FROM chunks WHERE status = 'done' AND (document_id IN ('src1', 'src2') OR folder IN ('f3')) AND owner = 'u2'")
def flt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(scope.retrieval_scope(documents=["src1", "src2"], folders=["f3"], owner="u2")).select("id", "document_id", "folder")


@query("flt1_empty_folder_scope", C + "SELECT id FROM chunks WHERE FALSE")
def flt1_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list of folders is an empty scope; an empty list of documents restricts nothing."""
    return chunks(spark, sf_dir).where(scope.retrieval_scope(documents=[], folders=[])).select("id")


@query("flt2_agent_scope", C + "SELECT id, folder FROM chunks WHERE folder = 'f2'")
def flt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(scope.agent_scope(documents=["src1"], folder="f2")).select("id", "folder")


@query("flt3_memory_scope", M + "SELECT id, scope FROM memory WHERE tenant_id = 't1' AND user_id = 'u4' AND status = 'active' AND (valid_day IS NULL OR valid_day > 10) AND (scope IN ('user', 'summary') OR scope = 'project' AND project_id = 'p1')")
def flt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).where(scope.memory_scope("t1", "u4", 10, project="p1")).select("id", "scope")


@query("flt4_null_exact_scope", C + "SELECT id, lang FROM chunks WHERE folder IS NULL AND table_id IS NULL")
def flt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null folder and null project match exactly null."""
    return chunks(spark, sf_dir).withColumnRenamed("table_id", "project").where(scope.translation_scope(None, None)).select("id", "lang")


@query("flt5_kind_and_dates", "SELECT event_id, event_type, cast(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND cast(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def flt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")  # the condition is on the stored column, so that it reaches the scan
    inside = (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & inside).select("event_id", "event_type", day.alias("day"))


@query("flt6_name_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 10")
def flt6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("ring")).orderBy("p_name", "p_partkey").limit(10).select("p_partkey", "p_name")


@query("flt7_ilike", M + "SELECT id, kind FROM memory WHERE content ILIKE '%THE ER%'")
def flt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).where(F.col("content").ilike("%THE ER%")).select("id", "kind")


@query("flt8_two_stage_regex", """
WITH s AS (SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*The[.\\s]') THEN 1 WHEN regexp_matches(text, '(^|[^A-Za-z])The([^A-Za-z]|$)') THEN 2 END AS stage, source FROM documents)
SELECT doc_id, source, stage FROM (SELECT *, min(stage) OVER (PARTITION BY source) AS best FROM s WHERE stage IS NOT NULL) WHERE stage = best""")
def flt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a source whose text begins with a word; where there is none, those that hold it anywhere."""
    strict, broad = F.col("text").rlike(r"^\s*The[.\s]"), F.col("text").rlike("(^|[^A-Za-z])The([^A-Za-z]|$)")
    staged = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(strict, 1).when(broad, 2).alias("stage")).where("stage is not null")
    best = staged.groupBy("source").agg(F.min("stage").alias("stage"))
    return staged.join(best, ["source", "stage"]).select("doc_id", "source", "stage")


@query("flt9_caption_regex", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)(^|[^0-9])82[0-9]([^0-9]|$)') ORDER BY page_id LIMIT 8")
def flt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").rlike("(?i)(^|[^0-9])82[0-9]([^0-9]|$)")).orderBy("page_id").limit(8).select("page_id", "url")


@query("flt10_tables_of_documents", C + "SELECT id, document_id, table_id FROM chunks WHERE kind = 'table' AND status = 'done'")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("kind = 'table' and status = 'done'").select("id", "document_id", "table_id")


@query("flt11_json_key_not_true", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS DISTINCT FROM '7'")
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(~F.get_json_object("props", "$.k").eqNullSafe(F.lit("7"))).select("event_id")


@query("flt12_json_key_exists", "SELECT event_type, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS with_k, count(*) FILTER (WHERE json_extract_string(props, '$.z') IS NOT NULL) AS with_z FROM events GROUP BY 1")
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda k: F.count_if(F.get_json_object("props", f"$.{k}").isNotNull())
    return table(spark, sf_dir, "events").groupBy("event_type").agg(has("k").alias("with_k"), has("z").alias("with_z"))


@query("flt13_member_of_list", "SELECT d.doc_id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(wanted, "doc_id", "left_semi")


@query("flt14_all_or_nothing_scope", C + """, asked AS (SELECT DISTINCT owner, document_id FROM chunks WHERE id % 50 = 0), seen AS (SELECT DISTINCT owner, document_id FROM chunks WHERE status = 'done')
SELECT a.owner, count(*) AS asked, count(s.document_id) AS visible, count(*) = count(s.document_id) AS allowed FROM asked a LEFT JOIN seen s ON a.owner = s.owner AND a.document_id = s.document_id GROUP BY 1""")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request is allowed only where every document it names is visible to its owner."""
    rows = chunks(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select("owner", "document_id").distinct()
    seen = rows.where("status = 'done'").select("owner", "document_id", F.lit(True).alias("seen")).distinct()
    found = asked.join(seen, ["owner", "document_id"], "left").groupBy("owner").agg(F.count("*").alias("asked"), F.count("seen").alias("visible"))
    return found.withColumn("allowed", F.col("asked") == F.col("visible"))


@query("flt15_stale_status_recovery", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'error' ELSE o_orderstatus END AS status FROM orders")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(stale, "error").otherwise(F.col("o_orderstatus")).alias("status"))


@query("flt16_degenerate_text", """
WITH w AS (SELECT doc_id, length(text) AS n, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, n > 8000 OR len(w) >= 60 AND len(list_distinct(w)) < 0.35 * len(w) AS degenerate FROM w""")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of over 8000 characters, or of 60 words or more of which less than 35 % differ."""
    words = F.array_remove(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+"), "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n"), words.alias("w"))
    bad = (F.col("n") > 8000) | ((F.size("w") >= 60) & (F.size(F.array_distinct("w")) < 0.35 * F.size("w")))
    return rows.select("doc_id", bad.alias("degenerate"))


@query("flt18_instruction_markers", "SELECT conv_id, turn FROM conversations WHERE len(list_filter(['ignore previous', 'the the', 'system prompt', 'you are now'], lambda m: contains(lower(text), m))) > 0")
def flt18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold any of some marker phrases, whatever their case."""
    low = F.lower("text")
    any_of = F.lit(False)
    for m in ("ignore previous", "the the", "system prompt", "you are now"):
        any_of = any_of | low.contains(m)
    return table(spark, sf_dir, "conversations").where(any_of).select("conv_id", "turn")


@query("flt19_translatable", "SELECT p_partkey, p_name FROM part WHERE length(p_name) >= 12 AND contains(p_name, ' ') AND regexp_matches(p_name, '[a-z]') AND NOT regexp_matches(p_name, '^[A-Z0-9 ]+$')")
def flt19(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").where((F.char_length(n) >= 12) & n.contains(" ") & n.rlike("[a-z]") & ~n.rlike("^[A-Z0-9 ]+$")).select("p_partkey", "p_name")


@query("flt21_unique_running_header", """
WITH h AS (SELECT doc_id, source, lower(trim(string_split(text, chr(10))[1])) AS header FROM documents)
SELECT doc_id, source FROM (SELECT *, count(*) OVER (PARTITION BY source, header) AS n FROM h) WHERE n = 1""")
def flt21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose first line occurs once in their source; counted by a partial aggregate, then joined."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.trim(F.split("text", "\n")[0])).alias("header"))
    once = rows.groupBy("source", "header").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return once.select("doc_id", "source")


@query("flt22_retained_chunks", C + ", k AS (SELECT * FROM chunks WHERE kind IN ('table', 'image') OR n_chars >= 400) SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY idx) - 1 AS new_idx FROM k")
def flt22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, images and chunks long enough, numbered anew."""
    kept = chunks(spark, sf_dir).where("kind in ('table', 'image') or n_chars >= 400")
    return kept.select("document_id", "id", (F.row_number().over(Window.partitionBy("document_id").orderBy("idx")) - 1).alias("new_idx"))


@query("prj2_snippet", "SELECT doc_id, substr(coalesce(nullif(text, ''), source), 1, 400) AS snippet, round(n_chars / 7.0, 4) AS score FROM documents")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(text, 1, 400).alias("snippet"), F.round(F.col("n_chars") / 7.0, 4).alias("score"))


@query("prj3_citation_object", "SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 4) AS bbox, label FROM embeddings")
def prj3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("bbox"), "label")


@query("jn1_chunks_with_documents", "SELECT l_orderkey, l_linenumber, o_orderstatus, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def jn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_custkey")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("jn2_folders_with_counts", "SELECT c_custkey, count(o_orderkey) AS n_documents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def jn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with the number of their rows, none included; counted before the join."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_documents"))


@query("jn4_interval_overlap", C + """, a AS (SELECT * FROM chunks WHERE id % 50 = 0) SELECT a.id AS anchor, c.id AS other FROM a JOIN chunks c ON a.document_id = c.document_id AND a.id <> c.id AND a.page_start <= c.page_end + 1 AND a.page_end >= c.page_start - 1""")
def jn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose pages lie within one page of an anchor's (every 50th id); pages are part of the join key."""
    rows = chunks(spark, sf_dir).select("id", "document_id", "page_start", "page_end")
    a = rows.where("id % 50 = 0").select(F.col("id").alias("anchor"), "document_id", F.col("page_start").alias("s"), F.col("page_end").alias("e"))
    reach = a.select("*", F.explode(F.sequence(F.col("s") - 1, F.col("e") + 1)).alias("page"))
    cover = rows.select("*", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return reach.join(cover, ["document_id", "page"]).where("anchor <> id").select("anchor", F.col("id").alias("other")).distinct()


@query("jn6_exists_parent", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment = 'MACHINERY')")
def jn6(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(owners, "o_custkey", "left_semi").select("o_orderkey")


@query("jn7_current_revision", "SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate <= l_shipdate) AS current FROM lineitem")
def jn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row's parent exists in a fitting revision."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return li.join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce(F.col("o_orderdate") <= F.col("l_shipdate"), F.lit(False)).alias("current"))


@query("jn8_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("jn9_bridge", "SELECT n_name, s_suppkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey AND o_orderkey = l_orderkey GROUP BY 1, 2")
def jn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge rows whose two ends belong to the same tenant (nation), counted."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    events = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    both = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(events, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return both.groupBy("s_nationkey", "s_suppkey").agg(F.count("*").alias("n")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "n")


@query("jn10_optimistic_update", "SELECT d.doc_id, CASE WHEN length(d.text) = d.n_chars AND l.quality = 1 THEN 'kept' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update joined from another table that applies only where the row is still what it was."""
    updates = table(spark, sf_dir, "labels").select("doc_id", "quality")
    same = (F.char_length("text") == F.col("n_chars")) & (F.col("quality") == 1)
    return table(spark, sf_dir, "documents").join(updates, "doc_id", "left").select("doc_id", F.when(same, "kept").otherwise(F.col("lang")).alias("lang"))


@query("jn11_exact_hash_lookup", """
WITH s AS (SELECT doc_id, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS norm FROM documents), m AS (SELECT norm, min(doc_id) AS memory_id FROM s GROUP BY 1)
SELECT s.doc_id, sha256(s.norm) AS hash, memory_id FROM s JOIN m USING (norm) WHERE s.doc_id <> memory_id""")
def jn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that an earlier row has, case and white space aside: looked up by hash, checked by text."""
    norm = F.regexp_replace(F.trim(F.lower("text")), r"\s+", " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", norm.alias("norm")).withColumn("hash", F.sha2("norm", 256))
    known = rows.groupBy("hash", "norm").agg(F.min("doc_id").alias("memory_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(known.withColumnRenamed("norm", "known"), "hash").where("norm = known and doc_id <> memory_id").select("doc_id", "hash", "memory_id")


@query("jn12_semi_two_columns", C + "SELECT id FROM chunks c WHERE kind = 'image' AND EXISTS (SELECT 1 FROM chunks t WHERE t.kind = 'image' AND t.status <> 'done' AND t.document_id = c.document_id AND t.page_start = c.page_start)")
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return rows.where("kind = 'image'").join(rows.where("kind = 'image' and status <> 'done'").select("document_id", "page_start"), ["document_id", "page_start"], "left_semi").select("id")


@query("jn14_owner_consistency", "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey IS DISTINCT FROM s_nationkey) AS crossed, count(*) AS n FROM customer JOIN supplier ON c_custkey = s_suppkey GROUP BY 1")
def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return both.groupBy("c_mktsegment").agg(F.count_if(~F.col("c_nationkey").eqNullSafe(F.col("s_nationkey"))).alias("crossed"), F.count("*").alias("n"))


@query("jn15_paired_full_match", """
WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS baseline, b.n AS candidate, a.n IS NOT NULL AND b.n IS NOT NULL AS paired FROM a FULL JOIN b ON a.user_id = b.user_id""")
def jn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    both = per("click", "baseline").join(per("view", "candidate"), "user_id", "full_outer")
    return both.withColumn("paired", F.col("baseline").isNotNull() & F.col("candidate").isNotNull())


@query("jn19_citation_rank_lookup", """
WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, unnest([1, 3, 9]) AS cited FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT c.conv_id, c.cited, a.turn FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.rank = c.cited""")
def jn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers looked up in the ranked sources of their conversation."""
    rows = table(spark, sf_dir, "conversations")
    ranked = rows.where("role = 'assistant'").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("cited"))
    cited = rows.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(9))).alias("cited"))
    return cited.join(ranked, ["conv_id", "cited"], "left").select("conv_id", "cited", "turn")


@query("agg1_count_by_document", C + "SELECT document_id, count(*) AS n FROM chunks WHERE status = 'done' GROUP BY 1")
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("status = 'done'").groupBy("document_id").agg(F.count("*").alias("n"))


@query("agg4_last_index", C + "SELECT document_id, coalesce(max(CASE WHEN kind = 'image' THEN idx END), 0) AS last_image FROM chunks GROUP BY 1")
def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("document_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "image", F.col("idx"))), F.lit(0)).alias("last_image"))


@query("agg5_distinct_pages", C + "SELECT DISTINCT document_id, page_start FROM chunks WHERE table_id IS NOT NULL")
def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("table_id is not null").select("document_id", "page_start").distinct()


@query("agg6_one_pass_audit", C + "SELECT document_id, count(*) FILTER (WHERE status = 'done') AS done, bool_or(kind = 'table') AS has_table, max(lang) AS last_lang, count(*) AS n FROM chunks GROUP BY 1")
def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("document_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.bool_or(F.col("kind") == "table").alias("has_table"), F.max("lang").alias("last_lang"), F.count("*").alias("n"))


@query("agg7_ordered_manifest", "SELECT conv_id, md5(string_agg(turn || ':' || md5(text), ',' ORDER BY turn)) AS manifest FROM conversations GROUP BY 1")
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest over the ordered rows of each conversation."""
    part = F.concat(F.col("turn").cast("string"), F.lit(":"), F.md5("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))).alias("all"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("all", lambda s: s["p"]), ",")).alias("manifest"))


@query("agg9_duplicate_ratio", """
WITH l AS (SELECT source, trim(x) AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents)), c AS (SELECT source, line, count(*) AS n, length(line) AS len FROM l WHERE length(line) >= 20 GROUP BY ALL)
SELECT source, round(sum((n - 1) * len) / sum(n * len), 6) AS ratio FROM c GROUP BY 1""")
def agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of characters in repeated lines of 20 characters or more, by source."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("x")).select("source", F.trim("x").alias("line")).where(F.char_length("line") >= 20)
    counted = lines.groupBy("source", "line").agg(F.count("*").alias("n")).withColumn("len", F.char_length("line"))
    return counted.groupBy("source").agg(F.round(F.sum((F.col("n") - 1) * F.col("len")) / F.sum(F.col("n") * F.col("len")), 6).alias("ratio"))


@query("agg12_category_report", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, quantile_disc(p_retailprice, 0.95) AS p95, sum(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END)::BIGINT AS economy FROM part GROUP BY 1")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(F.avg(price), 4).alias("mean"), F.round(F.median(price), 4).alias("median"), F.expr("percentile_disc(0.95) within group (order by p_retailprice)").alias("p95"), F.count_if(F.col("p_type") == "ECONOMY").alias("economy")
    )


@query("agg14_micro_rate", "SELECT user_id, coalesce(round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 0), 6), 0) AS rate FROM events GROUP BY 1")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.round(n("purchase") / F.nullif(n("click"), F.lit(0)), 6), F.lit(0.0)).alias("rate"))


@query("agg15_18_quantile_conventions", """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, quantile_disc(value, 0.95) AS nearest_rank, round(quantile_cont(value, 0.95), 6) AS linear, max(CASE WHEN r = floor(0.95 * (n - 1)) + 1 THEN value END) AS floored,
  round(median(value), 6) AS median, round(max(CASE WHEN r = floor(0.95 * (n + 1)) THEN value END) + (0.95 * (max(n) + 1) - floor(0.95 * (max(n) + 1))) * (max(CASE WHEN r = floor(0.95 * (n + 1)) + 1 THEN value END) - max(CASE WHEN r = floor(0.95 * (n + 1)) THEN value END)), 6) AS exclusive
FROM s GROUP BY 1""")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five conventions of a 95th percentile and median; the ranks come from counts per value and ranges of values, so that no task holds a type."""
    ranked = ordered.ranked_values(table(spark, sf_dir, "events"), "event_type", "value")
    at = lambda r: F.max(F.when((F.col("hi") >= r) & (F.col("hi") - F.col("c") < r), F.col("value")))
    p, n = 0.95, F.col("n")
    low = F.floor(p * (n + 1))
    got = ranked.groupBy("event_type").agg(
        at(F.ceil(p * n)).alias("nearest_rank"), at(F.floor(p * (n - 1)) + 1).alias("floored"), at(F.floor(p * (n - 1)) + 2).alias("above"), at(F.floor((n + 1) / 2)).alias("m1"), at(F.floor((n + 2) / 2)).alias("m2"), at(low).alias("e1"), at(low + 1).alias("e2"), F.max("n").alias("n")
    )
    part = lambda x: x - F.floor(x)
    linear = F.col("floored") + part(p * (n - 1)) * (F.coalesce("above", "floored") - F.col("floored"))
    exclusive = F.col("e1") + part(p * (n + 1)) * (F.col("e2") - F.col("e1"))
    return got.select("event_type", "nearest_rank", F.round(linear, 6).alias("linear"), "floored", F.round((F.col("m1") + F.col("m2")) / 2, 6).alias("median"), F.round(exclusive, 6).alias("exclusive"))


@query("agg20_multi_label_slices", """
WITH s AS (SELECT n_chars, unnest(list_distinct(['overall', 'lang:' || lang, 'source:' || source, CASE WHEN n_chars > 4000 THEN 'long' ELSE 'short' END])) AS slice FROM documents)
SELECT slice, count(*) AS n, round(avg(n_chars), 4) AS mean FROM s GROUP BY 1""")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row counts in many slices."""
    labels = F.array(F.lit("overall"), F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.when(F.col("n_chars") > 4000, "long").otherwise("short"))
    rows = table(spark, sf_dir, "documents").select("n_chars", F.explode(F.array_distinct(labels)).alias("slice"))
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("agg21_paired_deltas", """
WITH p AS (SELECT l_orderkey, sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS a, sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS b, min(l_returnflag) AS flag FROM lineitem GROUP BY 1)
SELECT flag, count(*) AS n, round(avg(b - a), 6) AS delta, count(*) FILTER (WHERE b > a) AS win, count(*) FILTER (WHERE b = a) AS tie, count(*) FILTER (WHERE b < a) AS loss FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired values: mean difference, wins, ties, losses."""
    q = lambda k: F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity")))
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(q(1).alias("a"), q(2).alias("b"), F.min("l_returnflag").alias("flag")).where("a is not null and b is not null")
    return pairs.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"), F.count_if(F.expr("b > a")).alias("win"), F.count_if(F.expr("b = a")).alias("tie"), F.count_if(F.expr("b < a")).alias("loss"))


@query("agg24_nested_json_sums", "SELECT event_type, sum(cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, round(avg(CASE WHEN cast(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM events GROUP BY 1")
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.round(F.avg((k > 50).cast("double")), 6).alias("ratio"))


@query("agg25_set_f1", """
WITH s AS (SELECT user_id, list_distinct(list(cast(floor(value / 20) AS BIGINT)) FILTER (WHERE event_type = 'click')) AS a, list_distinct(list(cast(floor(value / 20) AS BIGINT)) FILTER (WHERE event_type = 'view')) AS b FROM events GROUP BY 1),
c AS (SELECT user_id, coalesce(len(a), 0) AS na, coalesce(len(b), 0) AS nb, coalesce(len(list_intersect(a, b)), 0) AS x FROM s)
SELECT user_id, round(CASE WHEN nb = 0 THEN CASE WHEN na = 0 THEN 1 ELSE 0 END ELSE x / nb END, 6) AS precision_, round(CASE WHEN na = 0 THEN CASE WHEN nb = 0 THEN 1 ELSE 0 END ELSE x / na END, 6) AS recall,
  round(CASE WHEN na + nb = 0 THEN 1 ELSE 2 * x / (na + nb) END, 6) AS f1 FROM c""")
def agg25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of one set of buckets against another; two empty sets agree."""
    bucket = F.floor(F.col("value") / 20)
    seen = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").groupBy("user_id", bucket.alias("k")).agg(F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or(F.col("event_type") == "view").alias("b"))
    per = seen.groupBy("user_id").agg(F.count_if("a").alias("na"), F.count_if("b").alias("nb"), F.count_if(F.expr("a and b")).alias("x"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    c = users.join(per, "user_id", "left").na.fill(0)
    ratio = lambda d, other: F.when(F.col(d) == 0, F.when(F.col(other) == 0, 1.0).otherwise(0.0)).otherwise(F.col("x") / F.col(d))
    f1 = F.when(F.expr("na + nb = 0"), 1.0).otherwise(F.expr("2 * x / (na + nb)"))
    return c.select("user_id", F.round(ratio("nb", "na"), 6).alias("precision_"), F.round(ratio("na", "nb"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query("agg33_load_summary", "SELECT event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration, round(count(*) FILTER (WHERE value < 300) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS throughput, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def agg33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration from the first start to the last end, completed per second, and p95 by nearest rank."""
    span = (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return rows.groupBy("event_type").agg(F.round(span, 3).alias("duration"), F.round(F.count_if(F.col("value") < 300) / span, 9).alias("throughput"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("agg34_outcome_histogram", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS other, count(DISTINCT event_type) = 1 AS single FROM events GROUP BY 1")
def agg34(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(t == "error").alias("error"), F.count_if(t == "click").alias("click"), F.count_if(~t.isin("error", "click")).alias("other"), (F.min(t) == F.max(t)).alias("single"))


@query("agg38_upload_dashboard", C + "SELECT owner, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'error') AS error, sum(n_chars)::BIGINT AS chars, cast(round(100.0 * count(*) FILTER (WHERE status = 'done') / count(*)) AS BIGINT) AS percent FROM chunks GROUP BY 1")
def agg38(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("status") == "done")
    return chunks(spark, sf_dir).groupBy("owner").agg(done.alias("done"), F.count_if(F.col("status") == "error").alias("error"), F.sum("n_chars").alias("chars"), F.round(100.0 * done / F.count("*")).cast("long").alias("percent"))


@query("win1_section_counts", C + "SELECT id, count(*) OVER (PARTITION BY document_id, coalesce(nullif(section_id, ''), 'legacy:' || heading_path)) AS n FROM chunks")
def win1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same section, by an aggregate and a join rather than a window over a hot key."""
    rows = chunks(spark, sf_dir).select("id", "document_id", F.coalesce(F.nullif(F.col("section_id"), F.lit("")), F.concat(F.lit("legacy:"), "heading_path")).alias("section"))
    return rows.join(rows.groupBy("document_id", "section").agg(F.count("*").alias("n")), ["document_id", "section"]).select("id", "n")


@query("win5_last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def win5(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", r.alias("r")).where("r <= 3").drop("r")


@query("win6_transcript", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, string_agg(role || ': ' || length(text), ' | ' ORDER BY turn) AS transcript FROM l WHERE r <= 6 GROUP BY conv_id HAVING count(*) >= 2""")
def win6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six turns of a conversation in order; those with a single turn are left out."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    line = F.concat("role", F.lit(": "), F.char_length("text").cast("string"))
    last = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"), r.alias("r")).where("r <= 6")
    listed = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("all")).where(F.size("all") >= 2)
    return listed.select("conv_id", F.array_join(F.transform("all", lambda s: s["line"]), " | ").alias("transcript"))


@query("win9_first_occurrence", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def win9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every distinct text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query("win10_caption_lookahead", C + "SELECT id, next_id FROM (SELECT id, kind, lead(id) OVER (PARTITION BY owner ORDER BY idx) AS next_id, lead(kind) OVER (PARTITION BY owner ORDER BY idx) AS next_kind FROM chunks) WHERE kind = 'image' AND next_kind = 'section'")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("owner").orderBy("idx")
    rows = chunks(spark, sf_dir).select("id", "kind", F.lead("id").over(w).alias("next_id"), F.lead("kind").over(w).alias("next_kind"))
    return rows.where("kind = 'image' and next_kind = 'section'").select("id", "next_id")


@query("ord1_latest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def ord1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)


@query("ord3_nulls_first", C + "SELECT id, folder FROM chunks ORDER BY folder ASC NULLS FIRST, page_start DESC, id LIMIT 25")
def ord3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).orderBy(F.asc_nulls_first("folder"), F.desc("page_start"), "id").limit(25).select("id", "folder")


@query("ord4_budgeted_prefix", """
WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn FROM r WHERE n = 1 OR used <= 2000""")
def ord4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order until a budget of characters is spent; the first always stays."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.char_length("text")).over(w).alias("used"), F.row_number().over(w).alias("n"))
    return rows.where("n = 1 or used <= 2000").select("conv_id", "turn")


@query("ord6_newest_that_fit", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 3000")
def ord6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest turns are dropped until the rest fits the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.char_length("text")).over(w).alias("used")).where("used <= 3000").drop("used")


@query("set4_multiset_difference", "SELECT value, n_missing FROM (SELECT v AS value, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS n_missing FROM (SELECT l_quantity AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_quantity AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (v)) WHERE n_missing > 0")
def set4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one multiset has more of than another, by counts rather than expanded rows."""
    side = lambda f, n: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias(n))
    both = side("A", "a").join(side("R", "b"), "value", "full_outer").na.fill(0, ["a", "b"])
    return both.select("value", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n_missing")).where("n_missing > 0")


@query("set5_multiset_intersection", "SELECT p_size, least(count(*) FILTER (WHERE p_type = 'ECONOMY'), count(*) FILTER (WHERE p_type = 'PROMO')) AS n_common FROM part GROUP BY 1 HAVING least(count(*) FILTER (WHERE p_type = 'ECONOMY'), count(*) FILTER (WHERE p_type = 'PROMO')) > 0")
def set5(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t: F.count_if(F.col("p_type") == t)
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.least(n("ECONOMY"), n("PROMO")).alias("n_common")).where("n_common > 0")


@query("set7_first_by_short_reference", "SELECT substr(md5(text), 1, 2) AS ref, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def set7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each short reference, the first wins."""
    return table(spark, sf_dir, "documents").groupBy(F.substring(F.md5("text"), 1, 2).alias("ref")).agg(F.min("doc_id").alias("doc_id"))


@query("sec1_anonymous_sees_nothing", C + "SELECT id FROM chunks WHERE FALSE")
def sec1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.protected(chunks(spark, sf_dir), scope.Principal()).select("id")


@query("sec2_owner_policy", C + "SELECT id, owner FROM chunks WHERE owner = 'u3'")
def sec2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.protected(chunks(spark, sf_dir), scope.Principal("u3")).select("id", "owner")


@query("sec2_children_of_visible_parents", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def sec2_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("owner"))
    return scope.children_protected(table(spark, sf_dir, "lineitem"), parents, scope.Principal("7"), "l_orderkey").select("l_orderkey", "l_linenumber")
