"""Queries over document trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from .registry import query, table

#: Trees of this library; any fixed namespace would do.
NAMESPACE = str(uuid.uuid5(uuid.NAMESPACE_URL, "sparkloom:trees"))

SEGMENT = {
    "document_id": "source", "id": "doc_id", "idx": "doc_id", "kind": "case when doc_id % 4 = 0 then 'heading' when doc_id % 11 = 3 then 'table' when doc_id % 13 = 5 then 'equation' else 'paragraph' end",
    "heading_level": "case when doc_id % 4 = 0 then (doc_id * 7) % 6 end", "page_idx": "cast(floor(doc_id / 40) as int)", "source_text": "coalesce(text, '')", "source_ref": "concat('p', cast(floor(doc_id / 3) as bigint))",
}
SEGMENTS_SQL = f"s AS (SELECT {', '.join(f'{e} AS {c}' for c, e in SEGMENT.items())} FROM documents)"


def sql_uuid5(namespace: str, name: str) -> str:
    """The same id in SQL: bytes of both in hexadecimal digits, hashed."""
    h = f"sha1(unhex(replace({namespace}, '-', '') || hex(encode({name}))))"
    variant = f"substr('89ab', 1 + instr('0123456789abcdef', substr({h}, 17, 1)) - 1 - 4 * ((instr('0123456789abcdef', substr({h}, 17, 1)) - 1) // 4), 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(*(f"{e} as {c}" for c, e in SEGMENT.items()))
    return rows.withColumn("heading_level", F.col("heading_level").cast("int"))


NS = "'" + NAMESPACE + "'"
BUILT = f"""{SEGMENTS_SQL}, l AS (SELECT *, CASE WHEN kind = 'heading' THEN greatest(coalesce(heading_level, 1), 1) END AS level FROM s),
p AS (SELECT l.*, (SELECT max(h.idx) FROM l h WHERE h.document_id IS NOT DISTINCT FROM l.document_id AND h.kind = 'heading' AND h.idx < l.idx AND h.level < coalesce(l.level, 1000)) AS parent_idx FROM l),
o AS (SELECT p.*, row_number() OVER (PARTITION BY document_id, parent_idx ORDER BY idx) - 1 AS ordinal, row_number() OVER (PARTITION BY document_id, source_ref ORDER BY idx) - 1 AS seen, {sql_uuid5(NS, "document_id")} AS ns FROM p),
u AS (SELECT *, {sql_uuid5("ns", "(source_ref || CASE WHEN seen > 0 THEN '#' || seen ELSE '' END)")} AS stable_id, {sql_uuid5("ns", "'root'")} AS root_id FROM o),
nodes AS (SELECT u.document_id, u.stable_id, coalesce(h.stable_id, u.root_id) AS parent_id, u.ordinal, u.kind, u.level AS heading_level, CASE WHEN u.kind = 'heading' THEN u.source_text END AS title, u.page_idx AS page_start, u.id AS segment_id, u.idx
  FROM u LEFT JOIN u h ON h.document_id IS NOT DISTINCT FROM u.document_id AND h.idx = u.parent_idx
  UNION ALL SELECT DISTINCT document_id, root_id, NULL, 0, 'document', NULL, NULL, NULL, NULL, NULL FROM u)"""


@query("chk19_document_tree", f"WITH {BUILT} SELECT * FROM nodes")
def chk19_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each source: documents are its segments, every fourth a heading of levels 1 to 5, references repeat."""
    return trees.built(segments(spark, sf_dir), NAMESPACE)


#: A tree that isn't the order of the segments: by place in the source, each node has three children, the last one first.
HEAP = """r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS r FROM s),
heap AS (SELECT document_id, concat('n', r) AS stable_id, concat('n', (r + 1) // 3) AS parent_id, -r AS ordinal, id, r FROM r)"""


def heap(rows: DataFrame) -> DataFrame:
    """Nodes of that tree, each document's root without a segment."""
    from ..operators.ordered import running_in_parts

    r = running_in_parts(rows.select("document_id", "idx", "id", "heading_level"), ["document_id"], ["idx"], sums={"r": F.lit(1)})
    nodes = r.select("document_id", F.concat(F.lit("n"), F.col("r").cast("string")).alias("stable_id"), F.concat(F.lit("n"), F.floor((F.col("r") + 1) / 3).cast("string")).alias("parent_id"), (-F.col("r")).alias("ordinal"), F.col("heading_level").alias("heading_level"), F.col("id").alias("segment_id"))
    root = rows.select("document_id").distinct().select("document_id", F.lit("n0").alias("stable_id"), F.lit(0).cast("long").alias("ordinal"))
    return nodes.unionByName(root, allowMissingColumns=True)


@query(
    "chk4_preorder",
    f"""WITH RECURSIVE {SEGMENTS_SQL}, {HEAP}, w AS (SELECT document_id, stable_id, id, [ordinal] AS path FROM heap WHERE parent_id = 'n0' UNION ALL
SELECT h.document_id, h.stable_id, h.id, list_append(path, h.ordinal) FROM w JOIN heap h ON h.document_id IS NOT DISTINCT FROM w.document_id AND h.parent_id = w.stable_id)
SELECT document_id, id AS segment_id, row_number() OVER (PARTITION BY document_id ORDER BY path) AS place FROM w""",
)
def chk4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's place in the preorder of a tree that isn't the order of the segments."""
    nodes = heap(segments(spark, sf_dir))
    order = trees.preorder(nodes, "document_id", "stable_id", "parent_id", "ordinal")
    return nodes.where("segment_id is not null").join(order, ["document_id", "stable_id"]).select("document_id", "segment_id", "place")


@query(
    "sta9_relation_groups",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS document_id, l_orderkey % 500 AS a, l_partkey % 500 AS b FROM lineitem WHERE l_linenumber = 1),
z AS (SELECT document_id, a, b FROM e UNION SELECT document_id, b, a FROM e),
c AS (SELECT document_id, a, least(a, b) AS low FROM z UNION SELECT z.document_id, z.a, c.low FROM c JOIN z ON z.document_id = c.document_id AND z.b = c.a),
g AS (SELECT document_id, a AS block, min(low) AS low FROM c GROUP BY 1, 2), n AS (SELECT document_id, low, string_agg(block, ',' ORDER BY block) AS numbers FROM g GROUP BY 1, 2)
SELECT g.document_id, g.block, {sql_uuid5(NS, "('continues:' || numbers)")} AS group_id FROM g JOIN n USING (document_id, low)""",
)
def sta9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of linked blocks with their name-based ids: the first line of an order links two blocks of its supplier."""
    links = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("document_id"), (F.col("l_orderkey") % 500).alias("a"), (F.col("l_partkey") % 500).alias("b"))
    return trees.relation_groups(links, F.lit(NAMESPACE), "continues")


@query("chk4_tree_chunks")
def chk4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of sources in the order of that tree."""
    rows = segments(spark, sf_dir).withColumns({"idx": F.col("idx").cast("int"), "image": F.lit(None).cast("string"), "id": F.col("id").cast("string")})
    nodes = heap(rows)
    return trees.tree_chunks(rows, nodes, translated=F.upper)
