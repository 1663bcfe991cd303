"""Small-to-big expansion: an anchor chunk's relatives in its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_key() -> Column:
    """The section's id, or its heading path where there is none."""
    return F.coalesce(F.nullif(F.col("section_id"), F.lit("")), F.concat(F.lit("legacy:"), "heading_path"))


def relatives(anchors: DataFrame, chunks: DataFrame, page_radius: int = 1, dense: int = 2) -> DataFrame:
    """(anchor, anchor_rank, id, priority, distance): other chunks of an anchor's document that are tied to it.

    A tie is: the same section and (next to it, or a section with ``dense`` anchors or more,
    or pages within ``page_radius``), or the same table. The two kinds of tie are two
    equi-joins (document and section, document and table) instead of one join with OR, so
    that neither meets all chunks of a document.
    """
    keyed = chunks.withColumn("section", section_key())
    a = anchors.select(F.col("id").alias("anchor"), F.col("rank").alias("anchor_rank")).join(keyed.withColumnRenamed("id", "anchor"), "anchor")
    a = a.select("anchor", "anchor_rank", "document_id", "section", "table_id", F.col("idx").alias("a_idx"), F.col("page_start").alias("a_start"), F.col("page_end").alias("a_end"))
    in_section = a.groupBy("document_id", "section").agg(F.count("*").alias("n_anchors"))
    a = a.join(in_section, ["document_id", "section"])
    c = keyed.select("id", "document_id", "section", F.col("table_id").alias("c_table"), "idx", "page_start", "page_end")
    gap = F.abs(F.col("idx") - F.col("a_idx"))
    pages = (F.col("page_start") <= F.col("a_end") + page_radius) & (F.col("page_end") >= F.col("a_start") - page_radius)
    same = a.join(c, ["document_id", "section"]).where("id <> anchor")
    near = same.withColumn("priority", F.when(gap == 1, 1).when(F.col("n_anchors") >= dense, 2).when(pages, 3)).where("priority is not null")
    tables = a.join(c.drop("section"), (a.document_id == c.document_id) & (a.table_id == c.c_table)).drop(c.document_id).where("id <> anchor").withColumn("priority", F.lit(0))
    cols = ["anchor", "anchor_rank", "id", "priority", gap.alias("distance")]
    both = near.select(*cols).unionByName(tables.select(*cols))
    return both.groupBy("anchor", "anchor_rank", "id").agg(F.min("priority").alias("priority"), F.min("distance").alias("distance"))


def expanded(found: DataFrame, per_anchor: int, top: int) -> DataFrame:
    """(id, anchor_rank, priority, distance, position): the best of each anchor, collapsed by id with independent minima."""
    mine = Window.partitionBy("anchor").orderBy("priority", "distance", "id")
    best = found.withColumn("r", F.row_number().over(mine)).where(F.col("r") <= per_anchor)
    by_id = best.groupBy("id").agg(F.min("anchor_rank").alias("anchor_rank"), F.min("priority").alias("priority"), F.min("distance").alias("distance"))
    # The global order is cut to ``top`` by a distributed top-k before positions are numbered.
    cut = by_id.orderBy("anchor_rank", "priority", "distance", "id").limit(top)
    return cut.withColumn("position", F.row_number().over(Window.orderBy("anchor_rank", "priority", "distance", "id")))
