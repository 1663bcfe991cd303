"""Operator 13, Merkle dataset manifest: ternary trees by source, proofs by octopus multiproof.

H is the lowercase hex SHA-256 of its concatenated inputs, digests taken as hex text. A leaf is H of
doc_id, source, lang, n_chars and text, each ``-`` where null, else its UTF-8 byte count, ``:`` and the
value. In a source leaves ascend by doc_id; every three consecutive nodes (the last run may be shorter,
even one) become their H until one is left, the subroot. Subroots by source, null first and bytewise,
give the root in the same way. A document's proof is its runs' other nodes, level by level, left to right.

Leaf partitions are aligned runs of ``3 ** SPAN`` leaves. Of a partition's leaves the multiproof needs the
least set of nodes that they don't give themselves: level by level, the nodes of the touched runs that
are not known yet (``missing``). These coordinates, of all leaves together, are joined to the stored nodes
once; the task that holds the leaves derives the interior nodes that its proofs share and expands
every proof from both.

Scale: texts are read once, hashed in the scan's stage, and never shuffled; what travels is some 80 bytes
a document, twice. Places come from one range exchange and the counts of its parts, so that a source may
hold any share of the rows; equal rows are told apart by a number, so that they may fill several parts.
Stored are the nodes above the partitions only, some 1.5 of 3 ** SPAN leaves, in as many rounds
as there are SPAN levels. Nothing but the largest source's count and the number of sources reaches the driver.

Defined cases: a null doc_id sorts first and is never tampered with; rows that share a doc_id are leaves
of their own, ordered by leaf; null and empty texts differ (``-`` and ``0:``); a source's only leaf is its
subroot, the only subroot is the root, and the proof of a lone document is H of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, materialize

ARITY = 3
#: Levels of a leaf partition: 2,187 leaves.
SPAN = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; the sources' trees are numbered from 0.
TOP = -1


def digest(*parts: bytes) -> bytes:
    """H, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climbed(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The given nodes, which start at a run's start, and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes that, with these leaves of a tree of n, give all their proofs."""
    out = []
    known = np.unique(known)
    for level in range(depth(n)):
        runs = np.unique(known // ARITY)
        there = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(there[there < n], known, assume_unique=True)]
        known, n = runs, -(-n // ARITY)
    return out


def folded(leaf: bytes, proof: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf gives with its siblings, those to the left and to the right joined level by level."""
    for left, right in proof:
        leaf = digest(left, leaf, right)
    return leaf


def leaf_of(columns: dict[str, Column]) -> Column:
    """A row's leaf, 32 bytes."""
    parts = [F.when(columns[f].isNull(), "-").otherwise(F.concat(F.octet_length(columns[f]).cast("string"), F.lit(":"), columns[f])) for f in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place among the rows of ``key``, their number n, tree, the place of the key, and trees, the number of keys.

    Rows are range partitioned by key and order; a part's rows are counted as they stream by, and what
    precedes a part in a key comes from these counts, a row for each key and part.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie").withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = (None, False), 0
        for batch in batches:
            codes = batch.column(batch.schema.names.index(key)).dictionary_encode("encode")
            runs = codes.indices.to_numpy()
            starts = np.append(0, np.flatnonzero(np.diff(runs)) + 1) if len(runs) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(runs)))
            first = np.zeros(len(starts), np.int64)
            if len(starts):  # the first run may go on from the last batch, the last one into the next
                ends = [codes.dictionary[runs[starts[i]]].as_py() for i in (0, -1)]
                first[0] = seen if last == (ends[0], True) else 0
                last, seen = (ends[1], True), int(first[-1] + sizes[-1])
            place = np.arange(len(runs)) - np.repeat(starts, sizes) + np.repeat(first, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    dealt = materialize(dealt.mapInArrow(count, f"{schema}, place long"), "places")
    counts = dealt.groupBy(key, "part").agg(F.count("*").alias("c"))
    keys = counts.groupBy(key).agg(F.sum("c").alias("n"), F.min("part").alias("part"))
    # Keys ascend with their first part: within a part they are numbered, and parts add up.
    within = keys.withColumn("_r", F.row_number().over(Window.partitionBy("part").orderBy(F.col(key).asc_nulls_first())))
    per = keys.groupBy("part").agg(F.count("*").alias("k"))
    base = per.select(F.col("part"), (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("_b"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("trees"))
    keys = within.join(base, "part").select(F.col(key).alias("_key"), "n", (F.col("_b") + F.col("_r") - 1).alias("tree"), "trees")
    before = F.sum("c").over(Window.partitionBy(key).orderBy("part")) - F.col("c")
    offsets = counts.withColumn("_before", before).join(keys, F.col(key).eqNullSafe(F.col("_key"))).select("_key", F.col("part").alias("_part"), "_before", "n", "tree", "trees")
    offsets = materialize(offsets, "offsets")
    found = dealt.join(offsets, (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")))
    return found.withColumn("idx", F.col("place") + F.col("_before")).drop("part", "place", "_part", "_key", "_before")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered, tree, trees, idx, n): every document's place; ``tampered`` where the text without its line feeds has another leaf."""
    plain = {f: F.col(f).cast("string") for f in FIELDS}
    other = plain | {"text": F.replace(plain["text"], F.lit("\n"), F.lit(""))}
    altered = (crc32_mod("doc_id", 2) == 0) & F.col("doc_id").isNotNull() & (F.instr(plain["text"], "\n") > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain["source"].alias("source"), leaf_of(plain).alias("leaf"), F.when(altered, leaf_of(other)).alias("tampered"))
    return numbered(materialize(rows, "leaves"), "source", ["doc_id", "leaf"])


def grown(nodes: DataFrame, most: int, level: int, span: int = SPAN) -> DataFrame:
    """All nodes (tree, level, idx, hash) from those of one level, given with n, the tree's nodes there.

    Aligned runs of 3 ** span nodes climb so many levels in one task each; their tops are the next round's nodes.
    ``most`` is the largest tree's number of nodes.
    """

    def climb(key, table):
        order = np.argsort(table["idx"].to_numpy())
        nodes = [x.hex().encode() for x in table["hash"].take(order).to_pylist()]
        n, at = table["n"][0].as_py(), table["level"][0].as_py()
        levels = climbed(nodes, min(span, depth(n)))[1:]
        tree, block = key[0].as_py(), key[1].as_py()
        rows = [(tree, at + k, block * ARITY ** (span - k) + i, bytes.fromhex(h.decode()), -(-n // ARITY**k)) for k, hashes in enumerate(levels, 1) for i, h in enumerate(hashes)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], names=["tree", "level", "idx", "hash", "n"])

    out = nodes
    while most > 1:
        block = F.floor(F.col("idx") / ARITY**span).cast("long").alias("block")
        above = nodes.where("n > 1").groupBy("tree", block).applyInArrow(climb, "tree long, level int, idx long, hash binary, n long")
        above = materialize(above, "nodes")
        out = out.unionByName(above)
        level += span
        nodes, most = above.where(F.col("level") == level), -(-most // ARITY**span)
    return out


def proofs(docs: DataFrame, with_proof: bool = False, span: int = SPAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source, idx (place in the source), n (leaves there) of every document.

    ``with_proof`` adds proof, array<struct<left, right>>: the joined siblings of every level, for ``folded``.
    """
    rows = leaves(docs).withColumn("block", F.floor(F.col("idx") / ARITY**span).cast("long"))
    most, trees = rows.agg(F.max("n"), F.max("trees")).first()
    most, trees = most or 0, trees or 0

    def tops(key, table):
        order = np.argsort(table["idx"].to_numpy())
        n = table["n"][0].as_py()
        level = min(span, depth(n))
        top = climbed([x.hex().encode() for x in table["leaf"].take(order).to_pylist()], level)[-1]
        values = ([key[0].as_py()], [level], [key[1].as_py()], [bytes.fromhex(top[0].decode())], [-(-n // ARITY**level)])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(values, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], names=["tree", "level", "idx", "hash", "n"])

    lowest = rows.select("tree", "block", "idx", "leaf", "n").groupBy("tree", "block").applyInArrow(tops, "tree long, level int, idx long, hash binary, n long")
    nodes = grown(materialize(lowest, "nodes"), -(-most // ARITY**span), span, span)
    subroots = nodes.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "hash", F.lit(trees).cast("long").alias("n"))
    nodes = nodes.unionByName(grown(materialize(subroots, "subroots"), trees, 0, span)).drop("n")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, block, n, count in zip(*(c.to_pylist() for c in batch.columns)):
                mine = np.arange(block * ARITY**span, min(n, (block + 1) * ARITY**span))
                places = [(tree, *x) for x in missing(mine, n)] + [(TOP, *x) for x in missing(np.array([tree]), count)]
                out += [(tree, block, *x) for x in {*places, (tree, depth(n), 0), (TOP, depth(count), 0)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(zip(*out) if out else ((),) * 5)], names=["of", "block", "tree", "level", "idx"])

    # One row a leaf partition; nodes near a root are asked for by all: plain exchanges, which AQE splits.
    partitions = rows.groupBy("tree", "block").agg(F.max("n").alias("n"), F.max("trees").alias("trees"))
    asked = materialize(partitions.mapInArrow(wanted, "of long, block long, tree long, level int, idx long"), "asked")
    fetched = asked.join(materialize(nodes, "manifest"), ["tree", "level", "idx"]).select("of", "block", "tree", "level", "idx", "hash")
    columns = {"doc_id": pa.int64(), **dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), pa.string()), "verified": pa.bool_(), "source": pa.string(), "idx": pa.int64(), "n": pa.int64()}
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, idx long, n long"
    if with_proof:
        columns["proof"] = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        schema += ", proof array<struct<left: string, right: string>>"

    def expand(key, mine, got):
        if not len(mine):
            return pa.Table.from_arrays([pa.array([], t) for t in columns.values()], names=list(columns))
        mine = mine.take(np.argsort(mine["idx"].to_numpy()))
        tree, n, trees = (mine[c][0].as_py() for c in ("tree", "n", "trees"))
        node = {(t, level, i): h.hex().encode() for t, level, i, h in zip(*(got[c].to_pylist() for c in ("tree", "level", "idx", "hash")))}
        hashes = [h.hex().encode() for h in mine["leaf"].to_pylist()]
        levels = climbed(hashes, min(span, depth(n)))
        # Above the partition all its leaves share their siblings.
        shared = []
        for t, at, start, count in ((tree, key[1].as_py(), min(span, depth(n)), n), (TOP, tree, 0, trees)):
            for level in range(start, depth(count)):
                run, own = at // ARITY * ARITY, at % ARITY
                others = [node.get((t, level, run + i), b"") if i != own else b"" for i in range(ARITY)]
                shared.append((b"".join(others[:own]), b"".join(others[own + 1 :])))
                at //= ARITY
        root, subroot = node[TOP, depth(trees), 0].decode(), node[tree, depth(n), 0].decode()
        common = b"".join(x for pair in shared for x in pair)
        sides = [[(b"".join(nodes[i // ARITY * ARITY : i]), b"".join(nodes[i + 1 : i // ARITY * ARITY + ARITY])) for i in range(len(nodes))] for nodes in levels[:-1]]
        joined = [common]
        for pairs in reversed(sides):  # a node's proof is its own siblings, then its parent's proof
            joined = [left + right + joined[i // ARITY] for i, (left, right) in enumerate(pairs)]
        whole = folded(levels[-1][0], shared).decode()
        path = lambda i: [side[i // ARITY**k] for k, side in enumerate(sides)] + shared
        ends = [whole if t is None else folded(t.hex().encode(), path(i)).decode() for i, t in enumerate(mine["tampered"].to_pylist())]
        size = len(hashes)
        values = [mine["doc_id"], [h.decode() for h in hashes], [subroot] * size, [root] * size, [digest(p).decode() for p in joined], ends, [e == root for e in ends], mine["source"], mine["idx"], mine["n"]]
        if with_proof:
            values.append([[{"left": a.decode(), "right": b.decode()} for a, b in path(i)] for i in range(size)])
        return pa.Table.from_arrays([v.cast(t) if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns))

    held = rows.select("tree", "block", "idx", "n", "trees", "doc_id", "source", "leaf", "tampered")
    return held.groupBy("tree", "block").cogroup(fetched.groupBy("of", "block")).applyInArrow(expand, schema)


def verified_against(docs: DataFrame, proved: DataFrame) -> DataFrame:
    """doc_id, verified: whether documents, as they are now, still fold to the root with the proofs stored by ``proofs(..., with_proof=True)``.

    A document without a proof, and a proof without a document, are not verified. Rows of one doc_id are checked against each of its proofs.
    """
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaf_of({f: F.col(f).cast("string") for f in FIELDS}).alias("now"))
    stored = proved.select(F.col("doc_id").alias("_id"), "proof", "root")
    step = lambda at, p: F.sha2(F.concat(p["left"], at, p["right"]), 256)
    end = F.aggregate("proof", F.lower(F.hex("now")), step)
    found = now.join(stored, F.col("doc_id").eqNullSafe(F.col("_id")), "full_outer").withColumn("_ok", F.coalesce(end == F.col("root"), F.lit(False)))
    return found.groupBy(F.coalesce("doc_id", "_id").alias("doc_id")).agg(F.max("_ok").alias("verified"))


#: Bits of a decimal id, lowest of each character first, for the CRC.
_BITS = "flatten(list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))"
_CRC = f"xor(list_reduce({_BITS}, lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), 4294967295), 4294967295)"


def _hash(text: str) -> str:
    parts = [f"CASE WHEN {e} IS NULL THEN '-' ELSE strlen(cast({e} AS varchar)) || ':' || {e} END" for e in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, leaves: str, key: str) -> str:
    """The levels of the trees of ``leaves`` (key, idx, n, hash), and every node's siblings to the left and right."""
    return f"""
{name} AS (SELECT {key} AS k, 0 AS level, idx, n, hash FROM {leaves} UNION ALL
  SELECT k, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY k, level, n, idx // 3),
{name}_sides AS (SELECT a.k, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.k IS NOT DISTINCT FROM b.k AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.k, a.level, a.idx)"""


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_hash("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN {_hash("replace(text, chr(10), '')")} ELSE {_hash("text")} END AS now FROM documents),
l AS (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id FROM d),
{_tree("t", "l", "source")},
s AS (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM (SELECT k, hash FROM t WHERE n = 1)),
{_tree("u", "s", "0")},
f AS (SELECT l.id, l.source, 0 AS step, l.idx, l.now AS cur, '' AS proof FROM l UNION ALL
  SELECT f.id, f.source, step + 1, f.idx // 3, sha256(x.l || cur || x.r), proof || x.l || x.r FROM f JOIN t_sides x ON x.k IS NOT DISTINCT FROM f.source AND x.level = f.step AND x.idx = f.idx),
g AS (SELECT id, 0 AS step, s.idx, cur, proof FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1) f JOIN s ON s.k IS NOT DISTINCT FROM f.source UNION ALL
  SELECT g.id, step + 1, g.idx // 3, sha256(x.l || cur || x.r), proof || x.l || x.r FROM g JOIN u_sides x ON x.level = g.step AND x.idx = g.idx),
e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1)
SELECT l.doc_id, l.leaf, s.hash AS subroot, (SELECT hash FROM u WHERE n = 1) AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = (SELECT hash FROM u WHERE n = 1) AS verified, l.source, l.idx, l.n
FROM l JOIN e USING (id) JOIN s ON s.k IS NOT DISTINCT FROM l.source
"""
