"""Queries: dense and lexical search, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fulltext, fusion, lexical, vector
from .registry import query, table

Q = "vec_id % 50 = 0"
COSINE = "round(1 - list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9)"
VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def knn_sql(k: int, self_too: bool = True) -> str:
    return f"""
WITH {VECTORS}, d AS (SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS distance FROM v q, v WHERE q.vec_id % 50 = 0 {"" if self_too else "AND q.vec_id <> v.vec_id"})
SELECT query_id, vec_id, distance + 0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= {k}"""


@query("vec1_exact_knn", knn_sql(50))
def vec1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector.nearest(rows, rows.where(Q), 50)


@query(
    "vec2_two_lists_min",
    f"""
WITH {VECTORS}, a AS (SELECT vec_id, list_slice(e, 1, 32) AS e FROM v), b AS (SELECT vec_id, list_slice(e, 33, 64) AS e FROM v),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS distance FROM a q, a v WHERE q.vec_id % 50 = 0)),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS distance FROM b q, b v WHERE q.vec_id % 50 = 0)),
m AS (SELECT query_id, vec_id, min(distance) AS distance FROM (SELECT * FROM x WHERE r <= 20 UNION ALL SELECT * FROM y WHERE r <= 20) GROUP BY 1, 2)
SELECT query_id, vec_id, distance + 0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM m) WHERE rank <= 20""",
)
def vec2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors per row (halves): top-k of each, their union, the least distance, top-k again."""
    rows = table(spark, sf_dir, "embeddings")
    halves = [rows.select("vec_id", F.slice("embedding", a, 32).alias("embedding")) for a in (1, 33)]
    lists = [vector.nearest(h, h.where(Q), 20).select("query_id", "vec_id", "distance") for h in halves]
    least = lists[0].unionByName(lists[1]).groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return least.withColumn("rank", F.row_number().over(order)).where("rank <= 20")


@query(
    "vec6_truncate_normalize",
    """WITH n AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 16) AS e FROM embeddings)
SELECT vec_id, list_transform(e, lambda x: round(x / CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END, 6)) AS unit FROM n""",
)
def vec6(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.transform(vector.normalized(F.col("embedding"), 16), lambda x: F.round(x, 6))
    return table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("unit"))


@query(
    "vec7_strict_vector_audit",
    """SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64 OR embedding IS NULL) AS wrong_size,
  count(*) FILTER (WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0) AS zero_norm
FROM embeddings GROUP BY label""",
)
def vec7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label: of a wrong size, with elements that aren't finite, of zero length."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.count_if((F.size(e) != 64) | e.isNull()).alias("wrong_size"), F.count_if(bad).alias("not_finite"), F.count_if(vector.norm(e) == 0).alias("zero_norm")
    )


@query(
    "vec8_neighbour_cosine",
    f"WITH {VECTORS} SELECT q.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS similarity FROM v q JOIN v ON v.vec_id = q.vec_id + 1",
)
def vec8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
POSTINGS = f"""t AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM t) GROUP BY 1, 2)"""


@query(
    "lex1_match_all_terms",
    f"""
WITH {POSTINGS}, q AS (SELECT item_id AS query_id, unnest(u) AS term FROM (
    SELECT item_id, list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL) AS u FROM (SELECT item_id, {TOKENS} AS w FROM benchmark))),
h AS (SELECT query_id, id, count(*) AS n, round(sum(ln(1 + tf)), 6) AS score FROM p JOIN q USING (term) GROUP BY 1, 2),
n AS (SELECT query_id, count(*) AS needed FROM q GROUP BY 1)
SELECT query_id, id, rank, score FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h JOIN n USING (query_id) WHERE h.n = needed) WHERE rank <= 50""",
)
def lex1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all distinct terms of a benchmark item."""
    return lexical.match_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 50)


def web_queries(items: str = "w") -> str:
    """A search from an item's words: a phrase and a word without another, or two words."""
    return f"""concat('"', {items}[1], ' ', {items}[2], '" ', {items}[3], ' -', {items}[20], ' OR ', {items}[6], ' "', {items}[8], ' ', {items}[9], ' ', {items}[10], '"')"""


def sql_stems(words: str, ending: str) -> str:
    return f"list_transform({words}, lambda x: CASE WHEN length(x) >= 5 THEN regexp_replace(x, '{ending}', '') ELSE x END)"


WEB = rf"""
WITH i AS (SELECT item_id AS query_id, {TOKENS} AS w FROM benchmark), q AS (SELECT query_id, {web_queries()} AS said FROM i WHERE len(w) >= 20),
c AS (SELECT query_id, unnest(range(1, len(p) + 1)) AS literal, unnest(p) AS x FROM (SELECT query_id, regexp_extract_all(said, '-?"[^"]*"|[^\s"]+') AS p FROM q)),
a AS (SELECT query_id, literal, x, count(*) FILTER (WHERE lower(x) = 'or') OVER (PARTITION BY query_id ORDER BY literal) AS alternative FROM c),
l AS (SELECT query_id, alternative, literal, starts_with(x, '-') AS negated, list_filter(string_split_regex(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '') AS w FROM a WHERE lower(x) <> 'or'),
e AS ({" UNION ALL ".join(f"SELECT '{n}' AS config, query_id, alternative, literal, negated, {sql_stems('w', x)} AS w FROM l WHERE len(w) > 0" for n, x in fulltext.ENDINGS.items())}),
t AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
d AS ({" UNION ALL ".join(f"SELECT '{n}' AS config, id, {sql_stems('w', x)} AS w FROM t" for n, x in fulltext.ENDINGS.items())}),
p AS (SELECT config, id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
k AS (SELECT config, query_id, alternative, literal, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS place FROM e),
s AS (SELECT k.config, query_id, alternative, literal, id, pos - place AS start FROM k JOIN p ON p.config = k.config AND p.word = k.word GROUP BY 1, 2, 3, 4, 5, 6, size HAVING count(*) = size),
h AS (SELECT config, query_id, alternative, literal, id, count(*) AS times FROM s GROUP BY ALL),
n AS (SELECT config, query_id, alternative, count(*) FILTER (WHERE NOT negated) AS need FROM e GROUP BY ALL),
m AS (SELECT h.config, h.query_id, h.alternative, id, count(*) FILTER (WHERE NOT negated) AS have, count(*) FILTER (WHERE negated) AS bad, sum(ln(1 + times)) FILTER (WHERE NOT negated) AS score
  FROM h JOIN e USING (config, query_id, alternative, literal) GROUP BY 1, 2, 3, 4),
b AS (SELECT query_id, id, round(max(score), 6) AS score FROM m JOIN n USING (config, query_id, alternative) WHERE have = need AND bad = 0 GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM b) WHERE rank <= 50"""


@query("lex1_websearch", WEB)
def lex1_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches made of every benchmark item's words, with phrases, an alternative and an exclusion, in two configurations."""
    items = table(spark, sf_dir, "benchmark").select("item_id", lexical.tokens(F.col("text")).alias("w")).where(F.size("w") >= 20)
    at = lambda i: F.get("w", F.lit(i - 1))
    said = F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('" '), at(3), F.lit(" -"), at(20), F.lit(" OR "), at(6), F.lit(' "'), at(8), F.lit(" "), at(9), F.lit(" "), at(10), F.lit('"'))
    return fulltext.matches(table(spark, sf_dir, "documents"), items.select("item_id", said.alias("said")), "doc_id", "text", "item_id", "said", 50)


BM25 = f"""{POSTINGS}, q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
c AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM t), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.w) / avg_len))), 6) AS score
  FROM p JOIN q USING (term) JOIN df USING (term) JOIN t ON t.id = p.id, c GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 20)"""


@query("lex2_bm25", f"WITH {BM25} SELECT query_id, id, rank, score FROM b")
def lex2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 20)


@query(
    "lex5_trigram_similarity",
    r"""
WITH w AS (SELECT DISTINCT p_name AS s, unnest(string_split(lower(p_name), ' ')) AS word FROM part),
g AS (SELECT DISTINCT s, unnest(list_transform(range(1, length(word) + 2), lambda i: substr('  ' || word || ' ', i, 3))) AS t FROM w),
n AS (SELECT s, count(*) AS n FROM g GROUP BY 1),
x AS (SELECT a.s AS l, b.s AS r, count(*) AS c FROM g a JOIN g b USING (t) GROUP BY 1, 2),
y AS (SELECT l, r, round(c / (na.n + nb.n - c), 6) AS similarity FROM x JOIN n na ON na.s = l JOIN n nb ON nb.s = r)
SELECT l AS name, count(*) AS n_similar, round(sum(similarity), 4) AS total, min(r) AS first_similar FROM y WHERE similarity >= 0.5 GROUP BY l""",
)
def lex5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with similar names (trigram Jaccard of 0.5 or more), over distinct names."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = lexical.trigram_pairs(names, names, "name", "name", "name", "name", 0.5)
    return pairs.groupBy(F.col("left_id").alias("name")).agg(F.count("*").alias("n_similar"), F.round(F.sum("similarity"), 4).alias("total"), F.min("right_id").alias("first_similar"))


DENSE = f"""dense AS (SELECT * FROM (SELECT query_id, vec_id AS id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS distance FROM v q JOIN benchmark ON item_id = q.vec_id, v)) WHERE rank <= 50)"""
HYBRID = f"""{VECTORS}, {BM25}, {DENSE},
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM b) GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 20)"""


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dense (a benchmark item's vector is the one of its number) and lexical candidates."""
    vectors, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return vector.nearest(vectors, asked, 50).withColumnRenamed("vec_id", "id"), lex2(spark, sf_dir)


@query("hybrid_retrieval", f"WITH {HYBRID} SELECT query_id, id, rank, score, lang, n_chars FROM fused LEFT JOIN documents ON doc_id = id")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and lexical candidates of every benchmark item, fused by reciprocal ranks, with document fields."""
    fused = fusion.reciprocal_rank(list(lists(spark, sf_dir)), 20)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return fused.join(docs, "id", "left").select("query_id", "id", "rank", "score", "lang", "n_chars")


@query("fus3_weighted_blend", f"""
WITH {VECTORS}, {BM25}, {DENSE}
SELECT query_id, id, round(0.35 * coalesce(x.s, 0) + 0.65 * coalesce(y.s, 0), 6) AS score
FROM (SELECT query_id, id, score / (score + 10) AS s FROM b) x FULL JOIN (SELECT query_id, id, 1 - distance AS s FROM dense) y USING (query_id, id)""")
def fus3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical score squashed to 0..1 and cosine, blended 0.35 to 0.65."""
    dense, words = lists(spark, sf_dir)
    return fusion.blend(words.withColumn("score", F.col("score") / (F.col("score") + 10)), dense.withColumn("score", 1 - F.col("distance")))


@query("fus4_best_source_first", f"""
WITH {VECTORS}, {BM25}, {DENSE}, u AS (SELECT query_id, id, 0 AS source, rank FROM b UNION ALL SELECT query_id, id, 1, rank FROM dense d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = d.query_id AND b.id = d.id))
SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id ORDER BY source, rank, id) AS position FROM u""")
def fus4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits first, then dense hits of other documents."""
    dense, words = lists(spark, sf_dir)
    rest = dense.join(words.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = words.select("query_id", "id", F.lit(0).alias("source"), "rank").unionByName(rest.select("query_id", "id", F.lit(1).alias("source"), "rank"))
    order = Window.partitionBy("query_id").orderBy("source", "rank", "id")
    return both.select("query_id", "id", "source", F.row_number().over(order).alias("position"))


@query("fus5_borda_consensus", f"""
WITH {VECTORS}, {BM25}, {DENSE}, i AS (SELECT query_id, id, b.rank AS x, dense.rank AS y FROM b JOIN dense USING (query_id, id)), pts AS (SELECT query_id, id, x + y AS points FROM i)
SELECT query_id, id, points, row_number() OVER (PARTITION BY query_id ORDER BY points, id) AS position FROM pts""")
def fus5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus over the items that both lists rank."""
    dense, words = lists(spark, sf_dir)
    common = dense.select("query_id", "id").join(words.select("query_id", "id"), ["query_id", "id"])
    ranked = [df.join(common, ["query_id", "id"], "left_semi").select("query_id", F.lit(n).alias("ranker"), "id", "rank") for n, df in (("dense", dense), ("words", words))]
    return fusion.borda(ranked[0].unionByName(ranked[1]))


@query("fus6_rank_agreement", f"""
WITH {VECTORS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {COSINE} AS distance FROM v q, v WHERE q.vec_id % 50 = 0)) WHERE rank <= 30),
h AS (SELECT vec_id, list_slice(e, 1, 32) AS e FROM v),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {COSINE} AS distance FROM h q, h v WHERE q.vec_id % 50 = 0)) WHERE rank <= 30),
c AS (SELECT query_id, id, a.rank AS ra, b.rank AS rb FROM a JOIN b USING (query_id, id))
SELECT query_id, count(DISTINCT c.id) AS n_common, round(avg(CASE WHEN d.id IS NULL THEN NULL WHEN c.rb < d.rb THEN 1.0 ELSE 0.0 END), 6) AS agreement
FROM c LEFT JOIN c d USING (query_id) WHERE d.id IS NULL OR c.ra < d.ra OR c.id = d.id AND FALSE GROUP BY query_id
UNION ALL SELECT query_id, count(*), NULL FROM c GROUP BY 1 HAVING count(*) = 1""".replace("count(DISTINCT c.id) AS n_common", "(SELECT count(*) FROM c k WHERE k.query_id = c.query_id) AS n_common"))
def fus6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the top 30 by whole vectors and by their first half."""
    rows = table(spark, sf_dir, "embeddings")
    half = rows.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    a, b = (vector.nearest(x, x.where(Q), 30).withColumnRenamed("vec_id", "id") for x in (rows, half))
    return fusion.pairwise_agreement(a, b)


@query("rrk1_rerank_gate", f"""
WITH {HYBRID}, r AS (SELECT f.query_id, id, round((n_chars % 1000) / 1000.0, 4) AS rerank_score FROM fused f JOIN documents ON doc_id = id)
SELECT query_id, id, rerank_score, relevant, position FROM (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) >= 0.9 AS relevant, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS position FROM r) WHERE position <= 8""")
def rrk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates reordered by a given score (here: from their length), with the relevance gate."""
    found = hybrid(spark, sf_dir).where("n_chars is not null").select("query_id", "id", "n_chars")
    return fusion.rerank(found, (F.col("n_chars") % 1000) / 1000.0, 0.9, 8).select("query_id", "id", "rerank_score", "relevant", "position")
