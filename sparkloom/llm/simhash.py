"""Operator 3, SimHash near-dedup by vantage-point trees.

Fingerprint: a bit is 1 where more than half of a text's shingle hashes have it set.

Links: distinct fingerprints within ``limit`` bits. The bits are cut into blocks; two
fingerprints that differ in at most ``limit`` bits differ in at most limit // blocks bits of
some block. Each block has a vantage-point tree, built from a bounded sample, that
partitions the fingerprints by their Hamming distance (over the block's bits) to vantage
points; a fingerprint goes to its own leaf (as a point) and to every leaf whose shell the
triangle inequality can't exclude (as a query): leaves overlap at their boundaries by the
radius. More blocks mean a smaller radius and fewer copies in each of more trees; with limit + 1
blocks it is 0 and no leaf overlaps another. Within a leaf a second vantage-point tree over all bits finds the exact
pairs, pruning branches by the triangle inequality. A leaf emits links to the smallest
member of each local group only, at most one per member, so that a group of thousands never
yields all its pairs. Leaves beyond ``LEAF_ROWS`` points are dealt in pairs of chunks.

Sampled trees (``trees_sampled``) replace the blocks where the limit is far too wide for
them: each tree looks at some randomly chosen bits and finds a pair when those agree.

Defined cases: null and word-less texts have fingerprint zero and link like any other;
equal fingerprints are one node, so repeated rows cost nothing; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, materialize
from .graph import components

#: Fingerprints that trees are built from, points aimed at per leaf, and points a task compares at once.
SAMPLE, LEAF_AIM, LEAF_ROWS = 16_384, 2_048, 16_384
#: Trees of ``near_duplicates``: of three blocks one holds at most 4 // 3 = 1 of 4 differing bits, the radius within it.
BLOCKS = 3
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of n words, repeats included; fewer words: of them all; none: nothing."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    at, digest = starts.tolist(), xxhash.xxh64_intdigest
    hashes = [digest(joined[i : j - 1], 42) for i, j in zip(at, at[n:])]
    return np.array(hashes, np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of hashes (k = 0: themselves)."""
    if not k:
        return h
    h = h + np.uint64(MIX[0] * k & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[2])
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, k: int = 0) -> int:
    """The majority bits of 64-bit hashes, as an unsigned number."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):  # bounded memory for very long texts
        part = mixed(h[i : i + 65_536], k)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def parity_bits(h: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits of a set of hashes: a bit is 1 where an odd number of them falls on it.

    Two sets differ in at least as many elements as their bits differ.
    """
    return np.packbits((np.bincount((h % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1).astype(bool), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, distinct: bool = False, parity: int = 0) -> DataFrame:
    """(doc_id, f0 .. f<words - 1>): fingerprints of 64 * words bits, as signed longs; of distinct shingles where asked.

    With ``parity`` also (p0 .. p<parity - 1>, size): parity bits and the number of the distinct shingles.
    """
    names = ["doc_id", *(f"f{i}" for i in range(words)), *parity_columns(parity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(names) - 1, batch.num_rows), np.uint64)
            for r, text in enumerate(batch.column(1)):
                h = shingle_hashes(text.as_py(), shingle)
                h = np.unique(h) if distinct else h
                for k in range(words):
                    out[k, r] = fingerprint(h, k)
                if parity:
                    own = h if distinct else np.unique(h)
                    out[words:-1, r], out[-1, r] = parity_bits(own, parity), len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o.view(np.int64)) for o in out)], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def parity_columns(parity: int) -> list[str]:
    """Names of what ``fingerprints`` adds for parity bits."""
    return [*(f"p{i}" for i in range(parity)), "size"] if parity else []


def distance(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Hamming distance of rows of 64-bit words, over the bits of ``mask`` where given."""
    x = a ^ b
    return np.bitwise_count(x & mask if mask is not None else x).sum(-1, dtype=np.int16)


def blocks_of(bits: int, blocks: int) -> list[np.ndarray]:
    """Masks of disjoint blocks of neighbouring bits that cover all."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [mask_of(range(a, b), bits) for a, b in zip(cuts, cuts[1:])]


def mask_of(positions, bits: int) -> np.ndarray:
    mask = np.zeros(bits // 64, np.uint64)
    for p in positions:
        mask[p // 64] |= np.uint64(1 << (p % 64))
    return mask


def trees_sampled(bits: int, trees: int, picked: int, seed: int = 7) -> list[np.ndarray]:
    """Masks of ``picked`` bits chosen at random, one for each tree."""
    rng = np.random.default_rng(seed)
    return [mask_of(rng.choice(bits, picked, replace=False).tolist(), bits) for _ in range(trees)]


class Tree:
    """A vantage-point tree over a sample; its leaves are numbered shards.

    Node k has the vantage point ``points[k]`` and the threshold ``mu[k]``; ``near`` and ``far``
    are its children: another node, or leaf l as -1 - l.
    """

    def __init__(self, sample: np.ndarray, mask: np.ndarray, radius: int, leaf: int):
        self.mask, self.radius, self.leaves = mask, radius, 0
        nodes: list[list] = []
        self.root = self._grow(sample, max(1, leaf), np.random.default_rng(11), nodes)
        self.points = np.array([n[0] for n in nodes], np.uint64).reshape(len(nodes), sample.shape[1])
        self.mu, self.near, self.far = (np.array([n[i] for n in nodes], np.int64) for i in (1, 2, 3))

    def _grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator, nodes: list[list]) -> int:
        if len(points) > leaf:
            trial = points[rng.integers(len(points), size=8)]
            spread = [np.std(distance(points, v, self.mask)) for v in trial]
            vantage = trial[int(np.argmax(spread))]
            d = distance(points, vantage, self.mask)
            mu = int(np.median(d))
            mu -= mu >= d.max()
            inside = d <= mu
            if inside.any() and not inside.all():
                node = [vantage, mu, 0, 0]
                nodes.append(node)
                at = len(nodes) - 1
                node[2], node[3] = (self._grow(points[side], leaf, rng, nodes) for side in (inside, ~inside))
                return at
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row numbers, leaf, whether it is the row's own leaf) for every leaf that rows reach, level by level."""
        rows, at, own = np.arange(len(points)), np.full(len(points), self.root), np.ones(len(points), bool)
        done = []
        while len(rows):
            ended = at < 0
            done.append((rows[ended], -1 - at[ended], own[ended]))
            rows, at, own = rows[~ended], at[~ended], own[~ended]
            d, mu = distance(points[rows], self.points[at], self.mask), self.mu[at]
            inside = d <= mu
            steps = [(self.near[at], d <= mu + self.radius, inside), (self.far[at], d > mu - self.radius, ~inside)]
            rows, at, own = (np.concatenate(x) for x in zip(*((rows[reach], child[reach], own[reach] & mine[reach]) for child, reach, mine in steps)))
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (rows, at, own)


def pairs_within(points: np.ndarray, queries: np.ndarray, limit: int, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of (query, point) pairs at most ``limit`` bits apart, by a vantage-point tree over the points."""
    rng = np.random.default_rng(5)
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > small:
            vantage = points[p[rng.integers(len(p))]]
            d = distance(points[p], vantage)
            mu = int(np.median(d))
            mu -= mu >= d.max()
            inside = d <= mu
            if inside.any():
                e = distance(queries[q], vantage)
                todo.append((p[inside], q[e <= mu + limit]))
                todo.append((p[~inside], q[e > mu - limit]))
                continue
        for i in range(0, len(q), 4096):
            some = q[i : i + 4096]
            for j in range(0, len(p), 1024):
                hit = distance(queries[some][:, None], points[p[j : j + 1024]][None]) <= limit
                a, b = np.nonzero(hit)
                if len(a):
                    yield some[a], p[j : j + 1024][b]


def local_links(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(row, row of the group's first) for each of n rows that pairs tie to an earlier one."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    later = np.flatnonzero(root != np.arange(n))
    return list(zip(later.tolist(), root[later].tolist()))


def nearest_earlier(fp: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
    """(row, earlier row, distance) of the ``most`` nearest earlier rows that pairs tie to each row."""
    kept, held, size = np.zeros((0, 3), np.int64), [], 0

    def trimmed() -> np.ndarray:
        rows = np.concatenate([kept, *held])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
        starts = np.flatnonzero(np.append(True, np.diff(rows[:, 0]) != 0))[: len(rows)]
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        return rows[rank < most]

    for a, b in pairs:
        later = a > b
        a, b = a[later], b[later]
        held.append(np.stack([a, b, distance(fp[a], fp[b])], 1).astype(np.int64))
        size += len(a)
        if size > 1_000_000:
            kept, held, size = trimmed(), [], 0
    return trimmed() if held else kept


def met_before(differing: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether pairs, given by their differing bits, agree on all bits of one of these masks.

    Such a pair shares that tree's leaf, and if it is among the nearest of one leaf after another, the earliest has told it.
    """
    met = np.zeros(len(differing), bool)
    for mask in masks:
        met |= ~(differing & mask).any(1)
    return met


def apart(pairs: Iterator[tuple[np.ndarray, np.ndarray]], component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of different components."""
    for a, b in pairs:
        may = component[a] != component[b]
        yield a[may], b[may]


def possible(pairs: Iterator[tuple[np.ndarray, np.ndarray]], bits: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs whose sets may have that Jaccard similarity, by their parity bits and sizes; none that has it is left out.

    Sets x and y have it where at most (1 - similarity) / (1 + similarity) of |x| + |y| elements are in one only.
    """
    share = (1 - similarity) / (1 + similarity)
    for a, b in pairs:
        may = distance(bits[a], bits[b]) <= share * (sizes[a] + sizes[b]) + 1e-6
        yield a[may], b[may]


def near_links(points: DataFrame, limit: int, masks: list[np.ndarray], radius: int, words: int = 1, leaf_aim: int = LEAF_AIM, nearest: int = 0, asked: DataFrame | None = None, large: list[DataFrame] | None = None, parity: int = 0, similarity: float = 0.0, parts: DataFrame | None = None) -> DataFrame:
    """(a, b): links between the ids ``node`` of distinct fingerprints f0.. that tie all within ``limit``.

    ``points`` has one row per fingerprint. Links tie exactly the groups that all pairs
    found by the trees would tie. Trees come from a sample of at most ``SAMPLE`` rows by
    hash; only the sample and the row count reach the driver. With ``nearest`` the links are
    candidates to be verified: of each node to that many of the nearest smaller ones; where
    ``asked`` (node) is given, of its nodes only. ``large`` remembers the sizes of shards between
    two searches of the same points. With ``parity`` the points' parity bits travel along, and
    candidates that can't have that Jaccard ``similarity`` are left out where they are found. With ``parts`` (node, component)
    candidates of one component are left out there too.
    """
    names, extra = [f"f{i}" for i in range(words)], parity_columns(parity)
    if parts is not None:
        points = points.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    travelling = extra + (["component"] if parts is not None else [])
    spark = points.sparkSession
    n = points.count()
    share = min(1.0, SAMPLE / max(n, 1))
    chosen = points.where((F.pmod(F.xxhash64(*names), F.lit(1_000_003)) < int(share * 1_000_003) + 1)).select(*names).limit(2 * SAMPLE).toPandas()
    sample = np.unique(chosen.to_numpy(np.int64).view(np.uint64).reshape(-1, words), axis=0)  # in order: the same trees at a rerun
    trees = [Tree(sample, m, radius, int(leaf_aim * share)) for m in masks]
    held = spark.sparkContext.broadcast(trees)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fp = np.ascontiguousarray(pdf[names].to_numpy(np.int64)).view(np.uint64)
            for t, tree in enumerate(held.value):
                rows, leaf, own = tree.route(fp)
                yield pd.DataFrame({"shard": (t << 32) + leaf.astype(np.int64), "node": pdf["node"].to_numpy()[rows], "own": own, "ask": pdf["ask"].to_numpy(bool)[rows]} | {c: pdf[c].to_numpy()[rows] for c in names + travelling})

    columns = "node long, own boolean, ask boolean, " + ", ".join(f"{c} long" for c in names + travelling)
    if asked is None:
        sought = points.select("node", *names, *travelling, F.lit(True).alias("ask"))
    else:
        sought = points.join(asked.select("node", F.lit(True).alias("ask")), "node", "left").select("node", *names, *travelling, F.coalesce("ask", F.lit(False)).alias("ask"))
    # Routing is cheaper than keeping a copy of every fingerprint for each tree, so it runs twice.
    routed = sought.mapInPandas(route, f"shard long, {columns}")
    large = [] if large is None else large
    if not large:
        large.append(materialize(routed.groupBy("shard").agg(F.ceil(F.count("*") / LEAF_ROWS).cast("int").alias("chunks")).where("chunks > 1"), "large"))
    counted = large[0]
    # Shards beyond LEAF_ROWS go in pairs of chunks (i <= j). There are no more shards than rows of the samples.
    sized = routed.join(F.broadcast(counted), "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = sized.withColumn("i", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = dealt.withColumn("part", F.xxhash64("shard", F.least("i", "j"), F.greatest("i", "j"))).withColumn("tree", F.shiftright("shard", 32).cast("int")).drop("shard", "chunks", "i", "j")
    # Parts share tasks; a task sorts its rows and takes one part after the other.
    sorted_parts = keyed.repartition("part").sortWithinPartitions("part", "node")

    looked_at = np.array(masks, np.uint64)

    parts = parts is not None or None  # tasks need to know no more

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def links(pdf: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple[int, int]] = []
            node, part, tree = pdf["node"].to_numpy(), pdf["part"].to_numpy(), pdf["tree"].to_numpy()
            fp = np.ascontiguousarray(pdf[names].to_numpy(np.int64)).view(np.uint64)
            own, ask = pdf["own"].to_numpy(bool), pdf["ask"].to_numpy(bool)
            if parity:
                bits, sizes = np.ascontiguousarray(pdf[extra[:-1]].to_numpy(np.int64)).view(np.uint64), pdf["size"].to_numpy()
            component = pdf["component"].to_numpy() if parts is not None else None
            cuts = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                if b - a > 1:
                    f, mine, asking = fp[a:b], np.flatnonzero(own[a:b]), np.flatnonzero(ask[a:b])
                    if not len(asking):
                        continue
                    pairs = ((asking[q], mine[p]) for q, p in pairs_within(f[mine], f[asking], limit))
                    if parts is not None:
                        pairs = apart(pairs, component[a:b])
                    if parity:
                        pairs = possible(pairs, bits[a:b], sizes[a:b], similarity)
                    if nearest:
                        near = nearest_earlier(f, pairs, nearest)
                        near = near[~met_before(f[near[:, 0]] ^ f[near[:, 1]], looked_at[: tree[a]])]
                        found += [(int(node[a + i]), int(node[a + r]), d) for i, r, d in near.tolist() if node[a + i] != node[a + r]]
                        continue
                    found += [(int(node[a + i]), int(node[a + r]), 0) for i, r in local_links(b - a, pairs)]
            return pd.DataFrame(found, columns=["a", "b", "d"], dtype=np.int64)

        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["part"].to_numpy() == pdf["part"].to_numpy()[-1] if len(pdf) else np.zeros(0, bool)
            rest = pdf[last].reset_index(drop=True)
            yield links(pdf[~last])
        if rest is not None:
            yield links(rest)

    links = sorted_parts.mapInPandas(search, "a long, b long, d long")
    if not nearest:
        return links.select("a", "b").distinct()
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return links.distinct().withColumn("rank", rank).where(F.col("rank") <= nearest).select("a", "b")


def verified(links: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) between ids whose texts' sets of shingles have that Jaccard similarity or more."""
    wanted = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, x = [], None, np.zeros(0, np.uint64)
        for p, q in zip(a, b):
            if p is not last:
                last, x = p, np.unique(shingle_hashes(p, shingle))
            y = np.unique(shingle_hashes(q, shingle))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
        return pd.Series(out, dtype=float)

    mine, theirs = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    both = links.join(mine, "a").join(theirs, "b").withColumn("jaccard", jaccard("text_a", "text_b"))
    return both.where(F.col("jaccard") >= similarity).select("a", "b").distinct()


def verified_links(verify: Callable[[DataFrame], DataFrame], nearest: int, search: Callable[[int, DataFrame | None, DataFrame | None], DataFrame]) -> DataFrame:
    """Links that hold and that tie the same components as all candidates that hold.

    Each node's ``nearest`` candidates are tried first, and what holds is contracted to components. A node that may have
    more is then asked for all its candidates in other components, whether any of its first held or not: a candidate of its own
    component can't tie anything any more. So a group of copies costs a few rows a member, and no link between
    components is left untried.
    """
    links = materialize(search(nearest, None, None), "candidates")
    held = materialize(verify(links), "verified")
    full = materialize(links.groupBy(F.col("a").alias("node")).count().where(F.col("count") >= nearest).select("node"), "asked")
    if full.isEmpty():
        return held
    parts = materialize(components(held).select("node", "component"), "parts")
    rest = search(ALL, full, parts).join(links, ["a", "b"], "left_anti")
    return held.unionByName(materialize(verify(materialize(rest, "candidates")), "verified"))


def groups(prints: DataFrame, limit: int, masks: list[np.ndarray], radius: int, words: int = 1, leaf_aim: int = LEAF_AIM, nearest: int = 0, verify: Callable[[DataFrame], DataFrame] | None = None, parity: int = 0, similarity: float = 0.0) -> DataFrame:
    """``prints`` (doc_id, f0..) with component_id: the smallest doc_id that links reach.

    A null doc_id takes part in links but is never the smallest unless it stands alone.
    ``verify`` takes links and returns those that hold; the search for all candidates of a node
    leaves out those whose ``parity`` bits show that they can't.
    """
    names = [f"f{i}" for i in range(words)]
    prints = materialize(prints, "prints")
    # A null id can't name a group; its fingerprint gets a name below all ids' range.
    first = [F.min_by(c, "doc_id").alias(c) for c in parity_columns(parity)]  # of the document that is verified
    points = prints.groupBy(*names).agg(F.min("doc_id").alias("least"), *first)
    points = points.withColumn("node", F.coalesce("least", F.shiftright(F.xxhash64(*names), 2) - (1 << 62)))
    points = materialize(points, "points")
    if verify:
        sizes: list[DataFrame] = []
        links = verified_links(verify, nearest, lambda most, asked, parts: near_links(points, limit, masks, radius, words, leaf_aim, most, asked, sizes, parity if asked is not None else 0, similarity, parts))
    else:
        links = near_links(points, limit, masks, radius, words, leaf_aim)
    tied = components(links)
    real = F.when(F.col("node") == F.coalesce("least", F.col("node") + 1), F.col("least"))
    named = points.join(tied, "node", "left").withColumn("root", F.coalesce("component", "node")).withColumn("real", real)
    best = named.groupBy("root").agg(F.min("real").alias("component_id"))
    of_points = named.join(best, "root").select(*names, "component_id")
    return prints.join(of_points, names)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4, shingle: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: exact links at ``limit`` bits or fewer."""
    found = groups(fingerprints(docs, id_col, text_col, shingle), limit, blocks_of(64, blocks), limit // blocks)
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


#: The stage: fingerprints of 256 bits over five-word shingles; trees that look at 16 bits each, with small leaves.
STAGE_WORDS, STAGE_TREES, STAGE_BITS, STAGE_SHINGLE, STAGE_LEAF = 4, 48, 16, 5, 128
#: Standard deviations by which the bit limit of candidates exceeds the expected distance, and candidates a document.
STAGE_SPREAD, STAGE_NEAREST = 3, 2
#: Words of parity bits: they tell sets of up to about 700 shingles at 0.7 from 0.8; larger ones are told by their texts.
STAGE_PARITY = 8
#: Candidates without a limit.
ALL = 1 << 31


def bits_for(similarity: float, words: int) -> int:
    """Most bits in which sets of that Jaccard similarity are expected to differ (equal sizes: cosine 2J / (1 + J))."""
    return int(64 * words * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def candidate_bits(similarity: float, words: int) -> int:
    """``bits_for`` and STAGE_SPREAD standard deviations of the distance."""
    expected = bits_for(similarity, words)
    return expected + int(np.ceil(STAGE_SPREAD * np.sqrt(expected * (1 - expected / (64 * words)))))


def kept_of_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = STAGE_WORDS, trees: int = STAGE_TREES, picked: int = STAGE_BITS) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of near-duplicates; its columns stay.

    Trees find candidates: pairs at Jaccard 0.8 differ in 15 % of SimHash bits, too many for
    exact blocks, so the trees look at sampled bits, where a pair at 0.8 shares a leaf of one of
    48 trees in 97 of 100 cases. Fingerprints are of distinct shingles, and candidates may differ
    in three standard deviations more than expected. Each document's STAGE_NEAREST nearest candidates of
    smaller ids are verified first by the exact Jaccard similarity of the sets of shingles, then all its candidates in
    other components (``verified_links``), but for those that parity bits
    show to be below it (``possible``), so that a group of copies at 0.6 doesn't yield its pairs. Rows with a null id stay; rows that repeat an id stay together.
    """
    prints = fingerprints(docs, id_col, text_col, STAGE_SHINGLE, words, True, STAGE_PARITY)
    limit, masks = candidate_bits(similarity, words), trees_sampled(64 * words, trees, picked)
    found = groups(prints.where("doc_id is not null"), limit, masks, 0, words, STAGE_LEAF, STAGE_NEAREST, lambda links: verified(links, docs, id_col, text_col, STAGE_SHINGLE, similarity), STAGE_PARITY, similarity)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
