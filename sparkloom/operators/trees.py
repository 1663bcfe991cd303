"""Trees of document segments: built from headings, walked in preorder, checked, and cut into chunks.

A segment's parent is the nearest heading before it of a smaller level (any heading, for
other kinds): running maxima by level give all nearest smaller values at once. Preorder
follows from the sizes of subtrees, and both from pointers to ancestors that double their reach.
No task holds a document, and none folds over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunking
from .kept import kept, measured
from .ordered import running_in_parts

#: Kinds of segments that become nodes; fixed values.
KINDS = ("heading", "paragraph", "table", "image", "equation")


def uuid5(namespace: Column, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in a namespace: SHA-1 of both, with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def parents(segments: DataFrame) -> DataFrame:
    """``segments`` (document_id, id, idx, kind, heading_level) with parent_idx, the idx of the parent heading (null: the root), and level.

    One running maximum for each distinct level of a heading: the place of the last heading of that level so far.
    """
    head = F.col("kind") == "heading"
    rows = segments.withColumn("level", F.when(head, F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1))))
    levels = sorted(r.level for r in rows.where(head).select("level").distinct().collect())
    last = {f"_at{level}": F.when(F.col("level") == level, F.col("idx")) for level in levels}
    found = running_in_parts(rows, ["document_id"], ["idx"], maxima=last)
    # A heading looks below its level only, so that it doesn't find itself.
    under = [F.when(F.coalesce("level", F.lit(1 << 30)) > level, F.col(f"_at{level}")) for level in levels]
    parent = F.greatest(*under) if len(under) > 1 else under[0] if under else F.lit(None).cast("int")
    return found.withColumn("parent_idx", parent).drop(*last)


def built(segments: DataFrame, namespace: str) -> DataFrame:
    """Nodes (document_id, stable_id, parent_id, ordinal, kind, heading_level, title, page_start, segment_id, idx) of every document, its root included.

    ``segments`` have document_id, id, idx, kind, heading_level, page_idx, source_text and source_ref. Ids are named by the document
    and the reference, repeats of a reference numbered by #1, #2 in their order. Ordinals count the children of a node.
    """
    # Of the texts only titles go along, none of them twice.
    title = F.when(F.col("kind") == "heading", F.col("source_text"))
    named = segments.where(F.col("kind").isin(*KINDS)).select("document_id", "id", "idx", "kind", "heading_level", "page_idx", "source_ref", title.alias("title"))
    rows = parents(named)
    rows = running_in_parts(rows, ["document_id", "parent_idx"], ["idx"], sums={"ordinal": F.lit(1)})
    rows = running_in_parts(rows, ["document_id", "source_ref"], ["idx"], sums={"_seen": F.lit(1)})
    of = uuid5(F.lit(namespace), F.col("document_id").cast("string"))
    ref = F.when(F.col("_seen") == 1, F.col("source_ref")).otherwise(F.concat("source_ref", F.lit("#"), (F.col("_seen") - 1).cast("string")))
    rows = kept(rows.withColumn("stable_id", uuid5(of, ref)).withColumn("root_id", uuid5(of, F.lit("root"))))
    # Only headings have children: the join's right side is the headings.
    heads = rows.where("kind = 'heading'").select(F.col("document_id").alias("_d"), F.col("idx").alias("_i"), F.col("stable_id").alias("_p"))
    nodes = rows.join(heads, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("parent_idx") == F.col("_i")), "left")
    nodes = nodes.select("document_id", "stable_id", F.coalesce("_p", "root_id").alias("parent_id"), (F.col("ordinal") - 1).cast("long").alias("ordinal"), "kind", F.col("level").alias("heading_level"), "title", F.col("page_idx").alias("page_start"), F.col("id").alias("segment_id"), "idx")
    roots = rows.select("document_id", "root_id").distinct()
    none = {c: F.lit(None).cast(nodes.schema[c].dataType) for c in ("parent_id", "heading_level", "title", "page_start", "segment_id", "idx")}
    roots = roots.select("document_id", F.col("root_id").alias("stable_id"), F.lit(0).cast("long").alias("ordinal"), F.lit("document").alias("kind")).withColumns(none)
    return nodes.unionByName(roots)


def preorder(nodes: DataFrame, tree: str, node: str, parent: str, ordinal: str) -> DataFrame:
    """(tree, node, place): every node's place in its tree's preorder, from 0; children by ordinal, then id. A node that no root leads to has place null."""
    return placed(nodes.select(tree, node, parent, ordinal), tree, node, parent, ordinal).select(tree, node, "place")


def placed(nodes: DataFrame, tree: str, node: str, parent: str, ordinal: str) -> DataFrame:
    """``nodes`` with their ``place`` (see ``preorder``), kept.

    A node stands behind its parent and all that is below its earlier siblings. Two passes over pointers to ancestors, which jump to their target's target and so
    take as many rounds as the logarithm of the depth: the first sums up what is below every node, the second what stands between it and the root.
    Nodes go by numbers, so that a round moves three of them a node, and those whose pointers left the tree are not moved. A node may have
    any share of the children: sums are taken before the shuffle, and pointers meet one row of their target by an equi-join that AQE splits.
    """
    rows = measured(nodes.withColumn("_no", F.monotonically_increasing_id()))
    names = rows.select(F.col(tree).alias("_tree"), F.col(node).alias("_node"), F.col("_no").alias("up"))
    children = rows.where(F.col(parent).isNotNull()).select(F.col(tree).alias("_of"), F.col(parent).alias("_parent"), "_no", F.col(ordinal).alias("ordinal"), F.col(node).alias("node"))
    # Nodes of a missing parent drop out here.
    children = measured(children.join(names, F.col("_of").eqNullSafe(F.col("_tree")) & (F.col("_parent") == F.col("_node"))).select("_no", "up", "ordinal", "node"))
    roots = rows.where(F.col(parent).isNull()).select("_no", F.lit(None).cast("long").alias("up"))

    def jumped(at: DataFrame, sums: str) -> tuple[DataFrame, DataFrame]:
        """Rows (_no, up, sums) whose pointers have a target, and these with the pointer and sums of their target as far, more."""
        going = at.where("up is not null")
        return going, going.join(at.select(F.col("_no").alias("up"), F.col("up").alias("far"), F.col(sums).alias("more")), "up")

    # size: the node and what is below it, as far as its pointer reaches.
    at = measured(roots.unionByName(children.select("_no", "up")).withColumn("size", F.lit(1).cast("long")))
    left, rounds = at.where("up is not null").count(), 0
    while left:
        going, far = jumped(at, "size")
        below = going.groupBy(F.col("up").alias("_no")).agg(F.sum("size").alias("below"))
        pointers = at.where("up is null").select("_no", "up").unionByName(far.select("_no", F.col("far").alias("up")))
        sized = at.select("_no", "size").join(below, "_no", "left").select("_no", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size"))
        at, before, rounds = measured(pointers.join(sized, "_no")), left, rounds + 1
        left = at.where("up is not null").count()
        # As long as a way leads to a root, some pointer leaves the tree in every round: the rest are rings and what hangs on them.
        if left == before:
            break

    # place: what stands between the node and its pointer's target.
    sizes = at.where("up is null").select("_no", "size")
    ordered = running_in_parts(children.join(sizes, "_no"), ["up"], ["ordinal", "node"], sums={"upto": F.col("size")})
    at = measured(roots.withColumn("place", F.lit(0).cast("long")).unionByName(ordered.select("_no", "up", (F.col("upto") - F.col("size") + 1).alias("place"))))
    for _ in range(rounds):
        going, far = jumped(at, "place")
        at = measured(at.where("up is null").unionByName(far.select("_no", F.col("far").alias("up"), (F.col("place") + F.col("more")).alias("place"))))
    return measured(rows.join(at.where("up is null").select("_no", "place"), "_no", "left").drop("_no"))


def coverage_problems(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(document_id, problem, n): unknown, repeated, uncovered segments, nodes without a way to a root, other than one root; by document."""
    nodes = nodes if "place" in nodes.columns else placed(nodes, "document_id", "stable_id", "parent_id", "ordinal")
    refs = nodes.where("segment_id is not null").groupBy("document_id", "segment_id").agg(F.count("*").alias("times"))
    mine = segments.select("document_id", F.col("id").alias("segment_id"), F.lit(1).alias("mine"))
    both = mine.join(refs, ["document_id", "segment_id"], "full")
    told = F.when(F.col("mine").isNull(), "unknown segment").when(F.col("times").isNull(), "segment not covered").when(F.col("times") > 1, "segment covered twice")
    roots = nodes.groupBy("document_id").agg(F.count_if(F.col("parent_id").isNull()).alias("n")).where("n <> 1").select("document_id", F.lit("not one root").alias("problem"), "n")
    lost = nodes.where("place is null").groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", F.lit("node without a way to the root").alias("problem"), "n")
    return both.select("document_id", told.alias("problem")).where("problem is not null").groupBy("document_id", "problem").agg(F.count("*").alias("n")).unionByName(roots).unionByName(lost)


def input_hash(segments: DataFrame) -> DataFrame:
    """(document_id, input_hash): of all segments' idx, kind, page, level and text, by sums of their hashes, so that no task gathers a document."""
    one = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("idx", "kind", "page_idx", "heading_level", "source_text"))), 256)
    lane = lambda i: F.sum(F.conv(F.substring(one, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return segments.groupBy("document_id").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(lane(i).cast("string") for i in range(8))), 256).alias("input_hash"))


def in_tree_order(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``segments`` of documents without a coverage problem, idx replaced by the place in the tree's preorder and heading_level by the node's, and with its stable_id."""
    nodes = nodes if "place" in nodes.columns else placed(nodes, "document_id", "stable_id", "parent_id", "ordinal")
    at = nodes.where("segment_id is not null").select("document_id", F.col("segment_id").alias("id"), "place", F.col("heading_level").alias("_level"), "stable_id")
    # Kept with their size: few documents are broadcast, so that the others' segments aren't shuffled by document.
    bad = measured(coverage_problems(segments, nodes).select("document_id").distinct())
    good = segments.join(bad, "document_id", "left_anti")
    level = F.when(F.col("kind") == "heading", F.col("_level")).otherwise(F.col("heading_level"))
    return good.join(at, ["document_id", "id"]).withColumns({"idx": (F.col("place") - 1).cast("int"), "heading_level": level.cast("int")}).drop("place", "_level")


def tree_chunks(segments: DataFrame, nodes: DataFrame, translated: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks (document_id, idx, kind, heading_path, text_en, text_ru, page_start, page_end, segment_ids, tree_node_ids) in the tree's order.

    Chunks are numbered by their first segment's place. Documents whose tree doesn't cover every segment
    once have none; ``coverage_problems`` says why. ``translated``: see ``chunking.chunked``. Order and chunks are found without the texts.
    """
    tree = placed(nodes.select("document_id", "stable_id", "parent_id", "ordinal", "heading_level", "segment_id"), "document_id", "stable_id", "parent_id", "ordinal")
    rows = chunking.numbered(in_tree_order(chunking.outlines(segments, translated), tree))
    chunks = chunking.planned(rows, ["first"], also=("stable_id",)).withColumn("tree_node_ids", F.col("lines.stable_id"))
    return chunking.written(chunks, rows, segments, translated, ("tree_node_ids",))


#: Links of one document that a task holds at once.
TOGETHER = 500_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, least block linked to it) of links between blocks."""
    blocks, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(blocks))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        for side in (x, y):
            np.minimum.at(new, side, least)
            np.minimum.at(new, low[side], least)
        new = new[new]
        if (new == low).all():
            return blocks, blocks[low]
        low = new


def _grouped(most: int):
    """Links sorted by document become (document_id, blocks, whole): groups of linked blocks, the first their least; a document at a partition's edge, or of more than ``most`` links, may have more of them elsewhere."""

    def of(doc: list, x: np.ndarray, y: np.ndarray, place: np.ndarray, whole: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        # Blocks of several documents side by side: a document's number and its block become one number.
        names, code = np.unique(np.concatenate([x, y]), return_inverse=True)
        base = place * len(names)
        block, low = _forest(base + code[: len(x)], base + code[len(x) :])
        order = np.lexsort((block, low))
        block, low = block[order], low[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        mine = low[starts] // len(names)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(low)].astype(np.int32)), pa.array(names[block % len(names)], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([doc[i] for i in mine], kind), lists, pa.array(whole[mine])], names=["document_id", "blocks", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind, cut = None, None, True  # cut: the first document held may have had links before
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = table.schema.field(0).type
            held = table if held is None else pa.concat_tables([held, table])
            code = held.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            place = code.indices.to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(place, place[-1]))
            if last == 0 and held.num_rows < most:
                continue
            out, stop = held, last or held.num_rows
            out, held = out.slice(0, stop), out.slice(stop)
            whole = np.full(len(code.dictionary), True)
            whole[0] = not cut
            cut = last == 0
            if cut:
                whole[0] = False
            yield of(code.dictionary.to_pylist(), out.column(1).to_numpy(), out.column(2).to_numpy(), place[:stop], whole, kind)
        if held is not None and held.num_rows:
            code = held.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            place = code.indices.to_numpy(zero_copy_only=False)
            yield of(code.dictionary.to_pylist(), held.column(1).to_numpy(), held.column(2).to_numpy(), place, np.full(len(code.dictionary), False), kind)

    return run


def relation_groups(links: DataFrame, namespace: Column, label: str, most: int = TOGETHER) -> DataFrame:
    """(document_id, block, group_id) for links (document_id, a, b) between blocks: connected ones share a group, named by label and their sorted numbers.

    Links are range partitioned and sorted by document; a task finds the groups of every document that lies between its edges, and
    replaces the links of the others by those of each group's blocks to its least. Only these go through components by least labels, over rounds. A component's numbers are
    gathered to name it, so that a name needs as many numbers as its group has blocks.
    """
    ends = links.select("document_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("document_id is not null and a is not null and b is not null")
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.repartitionByRange(parts, "document_id", "a", "b").sortWithinPartitions("document_id")
    kind = ends.schema["document_id"].dataType.simpleString()
    groups = measured(ordered.mapInArrow(_grouped(most), f"document_id {kind}, blocks array<bigint>, whole boolean"))
    # A document may lie between the edges of no task, so that all of its parts say so.
    rest = groups.where("not whole").select("document_id", F.col("blocks")[0].alias("a"), F.explode("blocks").alias("b"))
    open_groups = _components(rest).groupBy("document_id", "low").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    every = groups.where("whole").select("document_id", "blocks").unionByName(open_groups.select("document_id", "blocks"))
    numbers = F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",")
    return every.select("document_id", F.explode("blocks").alias("block"), uuid5(namespace, F.concat(F.lit(f"{label}:"), numbers)).alias("group_id"))


def _components(ends: DataFrame) -> DataFrame:
    """(document_id, block, low): the least block that links (document_id, a, b) lead to."""
    both = measured(ends.unionByName(ends.select("document_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("document_id", F.col("a").alias("block")).agg(F.least(F.min("a"), F.min("b")).alias("low"))
    while True:
        labels = measured(labels)
        near = both.join(labels.withColumnRenamed("block", "b"), ["document_id", "b"]).groupBy("document_id", F.col("a").alias("block")).agg(F.min("low").alias("near"))
        new = labels.join(near, ["document_id", "block"]).withColumn("new", F.least("low", "near"))
        # A label's own label: long chains halve every round.
        onward = new.select("document_id", F.col("block").alias("new"), F.col("new").alias("onward"))
        new = measured(new.join(onward, ["document_id", "new"], "left").select("document_id", "block", "low", F.least("new", F.coalesce("onward", "new")).alias("new")))
        changed = not new.where("new <> low").isEmpty()
        labels = new.select("document_id", "block", F.col("new").alias("low"))
        if not changed:
            return labels
