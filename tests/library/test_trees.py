"""Trees against plain recursion, and documents whose trees are wrong."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunking, evaluation, ordered, trees
from sparkloom.plans.trees import NAMESPACE

SEGMENTS = "document_id string, id string, idx int, kind string, heading_level int, page_idx int, source_text string, translated_text string, image string"


def made(rng, name, n):
    rows = []
    for i in range(n):
        kind = rng.choice(["heading", "heading", "paragraph", "table"])
        rows.append((name, f"{name}{i}", i, kind, rng.choice([None, 0, 1, 2, 3, 7]) if kind == "heading" else None, i // 3, f"text {i} of {name}", None, None))
    return rows


def stack_parents(rows):
    """Parents by a stack of open headings."""
    out, stack = {}, []
    for _, _, idx, kind, level, *_ in rows:
        level = max(level if level is not None else 1, 1) if kind == "heading" else None
        if level is not None:
            while stack and stack[-1][0] >= level:
                stack.pop()
        out[idx] = stack[-1][1] if stack else None
        if level is not None:
            stack.append((level, idx))
    return out


def test_parents_equal_a_stack(spark):
    rng = random.Random(3)
    docs = {name: made(rng, name, n) for name, n in (("a", 1), ("b", 200), ("c", 37))}
    df = spark.createDataFrame([r for rows in docs.values() for r in rows], SEGMENTS).repartition(7)
    got = {(r.document_id, r.idx): r.parent_idx for r in trees.parents(df).collect()}
    assert got == {(name, i): p for name, rows in docs.items() for i, p in stack_parents(rows).items()}
    assert trees.parents(df.where("false")).collect() == []




def test_built_tree(spark):
    rows = made(random.Random(1), "d", 40)
    df = spark.createDataFrame(rows, SEGMENTS).withColumn("source_ref", F.lit("same"))
    nodes = trees.built(df, NAMESPACE).collect()
    of = uuid.uuid5(uuid.UUID(NAMESPACE), "d")
    assert {n.stable_id for n in nodes} == {str(uuid.uuid5(of, x)) for x in ["root", "same", *(f"same#{i}" for i in range(1, 40))]}
    children = {}
    for n in nodes:
        children.setdefault(n.parent_id, []).append(n)
    assert len(children[None]) == 1
    for below in children.values():
        assert sorted(n.ordinal for n in below) == list(range(len(below)))
        assert [n.idx for n in sorted(below, key=lambda n: n.ordinal)] == sorted((n.idx for n in below), key=lambda i: -1 if i is None else i)


def test_only_titles_of_the_texts_are_carried_through_the_ranges(spark, monkeypatch):
    carried, run = [], trees.running_in_parts
    monkeypatch.setattr(trees, "running_in_parts", lambda rows, *a, **k: carried.append(rows) or run(rows, *a, **k))
    df = spark.createDataFrame(made(random.Random(1), "d", 40), SEGMENTS).withColumn("source_ref", F.col("id"))
    titles = {n.segment_id: n.title for n in trees.built(df, NAMESPACE).collect() if n.segment_id}
    assert titles == {r.id: r.source_text if r.kind == "heading" else None for r in df.collect()}
    assert carried and not any("source_text" in rows.columns for rows in carried)


def walk(nodes):
    below = {}
    for node, parent, ordinal in nodes:
        below.setdefault(parent, []).append((ordinal, node))
    out = []

    def go(node):
        out.append(node)
        for _, child in sorted(below.get(node, [])):
            go(child)

    for _, root in below.get(None, []):
        go(root)
    return {node: i for i, node in enumerate(out)}


def test_preorder_equals_recursion(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for tree, n, shape in (("chain", 90, "chain"), ("star", 120, "star"), ("any", 150, "any"), ("one", 1, "any")):
        nodes = [(0, None, 0)]
        for i in range(1, n):
            nodes.append((i, {"chain": i - 1, "star": 0, "any": rng.randrange(i)}[shape], rng.randrange(5)))
        want |= {(tree, k): v for k, v in walk(nodes).items()}
        rows += [(tree, *x) for x in nodes]
    rows += [("cycle", 0, None, 0), ("cycle", 1, 2, 0), ("cycle", 2, 1, 0), ("cycle", 3, 0, 0), ("cycle", 4, 99, 0)]
    want |= {("cycle", 0): 0, ("cycle", 3): 1, ("cycle", 1): None, ("cycle", 2): None, ("cycle", 4): None}
    df = spark.createDataFrame(rows, "tree string, node int, parent int, ordinal int").repartition(5)
    assert {(r.tree, r.node): r.place for r in trees.preorder(df, "tree", "node", "parent", "ordinal").collect()} == want


def test_preorder_in_as_many_rounds_as_the_depth_asks_for(spark, monkeypatch):
    kept = []
    for name in ("kept", "measured"):
        monkeypatch.setattr(trees, name, lambda df, keep=getattr(trees, name): kept.append(df) or keep(df))
    nodes = [(i, (i - 1) // 30 if i else None, -i) for i in range(900)]
    df = spark.createDataFrame([("t", *x) for x in nodes] + [(None, *x) for x in nodes[:40]], "tree string, node int, parent int, ordinal int").repartition(3)
    got = {(r.tree, r.node): r.place for r in trees.preorder(df, "tree", "node", "parent", "ordinal").collect()}
    assert got == {("t", k): v for k, v in walk(nodes).items()} | {(None, k): v for k, v in walk(nodes[:40]).items()}
    assert len(kept) <= 10  # by the depth of 2, not by the length of the walk


def test_relation_groups(spark):
    links = spark.createDataFrame([("d", i, i + 1) for i in range(1, 60)] + [("d", 100, 90), ("d", 7, 7), ("e", 1, 2), ("e", 3, 3)], "document_id string, a int, b int")
    got = {(r.document_id, r.block): r.group_id for r in trees.relation_groups(links, F.lit(NAMESPACE), "x").collect()}
    name = lambda blocks: str(uuid.uuid5(uuid.UUID(NAMESPACE), "x:" + ",".join(map(str, blocks))))
    want = {("d", i): name(range(1, 61)) for i in range(1, 61)} | {("d", 90): name([90, 100]), ("d", 100): name([90, 100]), ("e", 1): name([1, 2]), ("e", 2): name([1, 2]), ("e", 3): name([3])}
    assert got == want


@pytest.mark.parametrize("most", [4, 25, 500_000])
def test_relation_groups_of_documents_of_any_size(spark, most):
    rng = random.Random(most)
    rows = [(d, rng.randrange(60), rng.randrange(60)) for d in range(40) for _ in range(rng.choice([1, 5, 30]))] + [(99, i, i + 1) for i in range(300)]
    group = {}
    for d, a, b in rows:
        mine = group.setdefault((d, a), {a}) | group.setdefault((d, b), {b})
        for x in mine:
            group[d, x] = mine
    links = spark.createDataFrame(rows, "document_id long, a int, b int").repartition(7)
    got = {(r.document_id, r.block): r.group_id for r in trees.relation_groups(links, F.lit(NAMESPACE), "x", most).collect()}
    assert got == {(d, x): str(uuid.uuid5(uuid.UUID(NAMESPACE), "x:" + ",".join(map(str, sorted(mine))))) for (d, x), mine in group.items()}


def test_ancestors_of_chains_and_rings_in_few_rounds(spark, monkeypatch):
    links = [(i, i - 1 if i % 10 else None) for i in range(2000)] + [(5000 + i, 5000 + (i + 1) % 7) for i in range(7)] + [(6000, 5003), (6001, 9999)]
    want = {i: (i - i % 10, i % 10) for i in range(2000) if i % 10} | {5000 + i: (None, None) for i in range(7)} | {6000: (None, None), 6001: (9999, 1)}
    steps, keep = [], evaluation.measured
    monkeypatch.setattr(evaluation, "measured", lambda df: steps.append(1) or keep(df))
    got = {r.child: (r.root, r.depth) for r in evaluation.ancestors(spark.createDataFrame(links, "child long, parent long").repartition(5)).collect()}
    assert got == want
    assert len(steps) <= 8  # by the longest chain of 9 links; 12 by the number of rows


@pytest.fixture
def segments(spark):
    rows = [(d, f"{d}{i}", i, "heading" if i % 4 == 0 else "table" if i % 5 == 4 else "paragraph", 1 if i % 4 == 0 else None, i, f"{d} {i} " + "word " * 60, None, None) for d in ("good", "twice", "lost", "cut", "hash") for i in range(12)]
    return spark.createDataFrame(rows, SEGMENTS)


def nodes_of(spark, segments):
    rows = [(r.document_id, f"n{r.idx}", "root", 11 - r.idx, 2 if r.idx == 0 else 1, r.id) for r in segments.collect()]
    rows = [r for r in rows if not (r[0] == "lost" and r[1] == "n3")]
    rows = [(*r[:2], "n7" if r[0] == "cut" and r[1] == "n7" else r[2], *r[3:]) for r in rows]
    rows += [("twice", "again", "root", 99, 1, "twice3"), ("twice", "other", "root", 98, 1, "nobody")]
    rows += [(d, "root", None, 0, None, None) for d in ("good", "twice", "lost", "cut", "hash")]
    return spark.createDataFrame(rows, "document_id string, stable_id string, parent_id string, ordinal int, heading_level int, segment_id string")


def test_coverage_problems(spark, segments):
    got = {(r.document_id, r.problem, r.n) for r in trees.coverage_problems(segments, nodes_of(spark, segments)).collect()}
    assert got == {("twice", "segment covered twice", 1), ("twice", "unknown segment", 1), ("lost", "segment not covered", 1), ("cut", "node without a way to the root", 1)}


def test_tree_chunks_follow_the_tree(spark, segments):
    rows = trees.tree_chunks(segments, nodes_of(spark, segments)).orderBy("document_id", "idx").collect()
    assert {r.document_id for r in rows} == {"good", "hash"}
    good = [r for r in rows if r.document_id == "good"]
    assert [r.idx for r in good] == list(range(len(good)))
    inside = [s for r in good for s in r.segment_ids]
    assert sorted(inside) == sorted(f"good{i}" for i in range(12))  # every segment once
    firsts = [min(11 - int(s[4:]) for s in r.segment_ids) for r in good]
    assert firsts == sorted(firsts)
    assert all([f"n{s[4:]}" for s in r.segment_ids] == r.tree_node_ids for r in good)


def test_tree_chunks_keep_no_texts_and_carry_none_through_ranges(spark, segments, monkeypatch):
    nodes = nodes_of(spark, segments)
    seen = []
    for module, names in ((trees, ("kept", "measured")), (chunking, ("kept", "measured", "running_in_parts")), (ordered, ("measured",))):
        for name in names:
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda df, *a, of=getattr(module, name), **k: seen.append(df.columns) or of(df, *a, **k))
    stored = trees.tree_chunks(segments.withColumn("translated_text", F.upper("source_text")), nodes).collect()
    assert len(stored) == 10 and all("WORD WORD" in r.text_ru and "word word" in r.text_en for r in stored)
    assert len(seen) > 10
    assert not [c for columns in seen for c in columns if "text" in c]
    # A translation that is made of the source gives the same rows.
    made = trees.tree_chunks(segments.drop("translated_text"), nodes, translated=F.upper).collect()
    assert {(r.document_id, r.idx): r for r in made} == {(r.document_id, r.idx): r for r in stored}


def test_input_hash_sees_every_field(spark, segments):
    whole = {r.document_id: r.input_hash for r in trees.input_hash(segments).collect()}
    for column, value in (("idx", F.col("idx") + 1), ("source_text", F.lit(None).cast("string")), ("page_idx", F.lit(None).cast("int")), ("kind", F.lit("x"))):
        other = segments.withColumn(column, F.when((F.col("document_id") == "hash") & (F.col("idx") == 5), value).otherwise(F.col(column)))
        changed = {r.document_id: r.input_hash for r in trees.input_hash(other).collect()}
        assert {d for d in whole if whole[d] != changed[d]} == {"hash"}
