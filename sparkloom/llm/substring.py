"""Operator 8, substring dedup: fuzzy passages by collinear chaining of k-mer seeds.

Seeds: of every ``WINDOW`` neighbouring runs of ``K`` words the one with the smallest hash,
so that an exact run of WINDOW + K - 1 = 9 words always has a seed in common: a copy with an edit
at every tenth word, or at fewer, is always a candidate. README gives recall by identity. Each seed is joined to its first occurrence only (the smallest doc_id;
that document keeps its text), never to all others: matches grow with the text, whatever the
size of a group. A document's matches with one earlier document are merged to diagonal
runs and chained in order, gaps costing in proportion to their length, with a Fenwick tree
that keeps the best chain ending at or before a position. Chains are then aligned word by word:
extended at both ends, over single edits too, and each gap is compared by itself: where
more than GAP_EDITS words differ and the gap is below IDENTITY the chain is split, so that
words between two passages are never cut and an exact run never falls with its neighbours.
Passages at IDENTITY or more are united per document; unions of MIN_WORDS words or more are
repeats.

Scale: seeds (a third of the words) are shuffled once and never written; texts once, to cut
the requested segments, each text once whatever the number of its chains. A task compares the
seeds of LOCAL documents before the shuffle, so that a seed of a third of all rows is one row
a batch there, and what it found is joined on (seed, batch's smallest document). A task chains
one document's matches at a time. Of a passage that many documents hold one range is cut; its
join key is hot, and AQE splits it.

Defined cases: words are runs of anything but ASCII white space, A-Z lower-cased; null,
empty and short texts have no seeds; repeats within one document don't count; rows with a
null id, and rows that repeat an id with different texts, are left as they are; rows that
repeat id and text share one result; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, materialize

K, WINDOW = 5, 5
MIN_WORDS, IDENTITY = 50, 0.8
#: Words between two parts of a chain, what a word of gap costs, and words fetched beyond a chain's ends.
MAX_GAP, GAP_COST, PAD = 60, 0.05, MIN_WORDS - K
#: Words between the seeds kept of a few words that repeat without a break; documents whose seeds a task compares itself.
TANDEM, LOCAL = 16, 2000
#: What ranges of earlier documents are multiples of.
BLOCK = 64
#: Differing words that a passage may hold in one gap, and the shortest block of equal words on a run's diagonal.
GAP_EDITS, LEAST_BLOCK = 5, 3
#: Words looked at beyond an edit, and how many of them must be equal, the first included.
AHEAD, AHEAD_EQUAL = 6, 4
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def seeds_of(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the seeds of a text, by position.

    Where a few words repeat without a break ("the the the ...") neighbouring seeds are equal; of
    those the first, the last and one in every TANDEM words stay. All of them have the same first
    place in the earlier document, from which each is extended over PAD words, so that the parts
    left between two of them are covered by the first one's extension.
    """
    words = ascii_words(text)
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs = runs * FACTOR + h[i : i + n]
    runs ^= runs >> np.uint64(31)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(29)
    span = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    at = np.unique(np.concatenate([view[i : i + 65_536].argmin(1) + np.arange(i, min(i + 65_536, len(view))) for i in range(0, len(view), 65_536)]))
    found = runs[at].view(np.int64)
    begins = np.append(True, (found[1:] != found[:-1]) | (np.diff(at) > window))
    step = (at - at[begins][np.cumsum(begins) - 1]) // TANDEM
    stay = begins | np.append(begins[1:], True) | np.append(True, np.diff(step) != 0)
    return found[stay], at[stay].astype(np.int32)


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc, at, leader, leads): seeds of every document, those of a task's documents compared already.

    Of each seed that several of LOCAL documents hold, only the rows of the smallest doc, the
    leader, go on to be compared with other tasks' (``leads`` marks one of them); the others only
    name their leader, so that of a seed that a third of all documents hold few rows meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, LOCAL):
                part = batch.slice(i, LOCAL)
                made = [seeds_of(t.as_py()) for t in part.column(1)]
                seed, at = (np.concatenate([m[c] for m in made]) for c in (0, 1))
                doc = np.repeat(part.column(0).to_numpy(), [len(m[0]) for m in made])
                order = np.lexsort((at, doc, seed))
                seed, doc, at = seed[order], doc[order], at[order]
                starts = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))[: len(seed)]
                sizes = np.diff(np.append(starts, len(seed)))
                leader = np.repeat(doc[starts], sizes)
                own = doc == leader
                leads = np.zeros(len(seed), bool)
                leads[starts] = doc[starts + sizes - 1] != doc[starts]
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(leader, pa.int64(), mask=own), pa.array(leads)], names=["seed", "doc", "at", "leader", "leads"])

    return docs.select("doc", "text").mapInArrow(run, "seed long, doc long, at int, leader long, leads boolean")


def first_matches(found: DataFrame) -> DataFrame:
    """(doc, at, of, of_at): each seed with its first place in the smallest doc that holds it.

    The rows of a seed lie one after another in (doc, at) order; only the first is remembered.
    Followers pass by (dealt by themselves) and then get their leader's match, a join whose keys
    have a row on one side and at most LOCAL documents' on the other.
    """
    names = ["seed", "doc", "at", "of", "of_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of, of_at = None, 0, 0
        for batch in batches:
            follows = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            seed, doc, at, leads = (batch.column(i).to_numpy(zero_copy_only=False)[~follows] for i in (0, 1, 2, 4))
            if len(seed):
                starts = np.flatnonzero(np.append(seed[0] != last, seed[1:] != seed[:-1]))
                sizes = np.diff(np.append(starts, len(seed)))
                ahead = len(seed) - int(sizes.sum())  # rows of the batch before's last seed
                first_doc = np.concatenate([np.full(ahead, of), np.repeat(doc[starts], sizes)])
                first_at = np.concatenate([np.full(ahead, of_at), np.repeat(at[starts], sizes)])
                last, of, of_at = seed[-1], first_doc[-1], first_at[-1]
                later = doc != first_doc
                for keep, nulls in ((later, 0), (leads, 2)):  # matches have no seed, leaders' matches no place
                    kept = [pa.array(v[keep], pa.int32() if i in (2, 4) else pa.int64(), mask=np.full(int(keep.sum()), i == nulls)) for i, v in enumerate((seed, doc, at, first_doc, first_at))]
                    yield pa.RecordBatch.from_arrays(kept, names=names)
            if follows.any():
                some = batch.filter(pa.array(follows))
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.nulls(some.num_rows, pa.int32())], names=names)

    key = F.when(F.col("leader").isNull(), F.col("seed")).otherwise(F.xxhash64("doc", "at"))
    ordered = found.repartition(key).sortWithinPartitions("seed", "doc", "at")
    rows = materialize(ordered.mapInArrow(run, "seed long, doc long, at int, of long, of_at int"), "matches")
    leaders = rows.where("at is null").select("seed", F.col("doc").alias("leader"), "of", "of_at")
    followers = rows.where("of_at is null").select("seed", "doc", "at", F.col("of").alias("leader"))
    return rows.where("seed is null").drop("seed").unionByName(followers.join(leaders, ["seed", "leader"]).select("doc", "at", "of", "of_at"))


class Fenwick:
    """Prefix maxima with the number of the element that holds them."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """The maximum over positions below i."""
        out = (-1e18, -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def diagonal_runs(y: np.ndarray, x: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(y, x, words) of matches that follow one another on a diagonal."""
    order = np.lexsort((y, y - x))
    y, x = y[order], x[order]
    new = np.flatnonzero((np.diff(y - x) != 0) | (np.diff(y) > WINDOW + K)) + 1
    lo, hi = np.append(0, new), np.append(new, len(y)) - 1
    return sorted(zip(y[lo].tolist(), x[lo].tolist(), (y[hi] - y[lo] + k).tolist()))


def best_chains(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of runs in order in both texts, the best first; each run is in one chain.

    A chain's score is its words less GAP_COST for every word of gap on either side, so that the
    best chain before a run is the maximum, over runs that end before it in the other text, of
    score + GAP_COST * (both ends): a prefix maximum in a Fenwick tree.
    """
    ends = sorted(range(len(runs)), key=lambda i: runs[i][0] + runs[i][2])
    x_ends = sorted({r[1] + r[2] for r in runs})
    ranks = {v: i for i, v in enumerate(x_ends)}
    tree, score, back, done = Fenwick(len(ranks)), [0.0] * len(runs), [-1] * len(runs), 0
    for i, (yi, xi, n) in enumerate(runs):
        while done < len(ends) and runs[ends[done]][0] + runs[ends[done]][2] <= yi:
            j = ends[done]
            y_end, x_end = runs[j][0] + runs[j][2], runs[j][1] + runs[j][2]
            tree.put(ranks[x_end], score[j] + GAP_COST * (y_end + x_end), j)
            done += 1
        best, j = tree.get(bisect_right(x_ends, xi))
        gain = best - GAP_COST * (yi + xi) if j >= 0 else 0.0
        score[i], back[i] = (n + gain, j) if gain > 0 else (float(n), -1)
    used, out = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def chains_of(y: np.ndarray, x: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains from matches at words y of a text and x of an earlier one, cut where a gap exceeds MAX_GAP words."""
    runs = diagonal_runs(y, x)
    if len(runs) == 1:
        return [runs]
    out = []
    for chain in best_chains(runs):
        part = [chain[0]]
        for a, b in zip(chain, chain[1:]):
            if max(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) > MAX_GAP:
                out.append(part)
                part = []
            part.append(b)
        out.append(part)
    return out


def chain(matches: DataFrame) -> DataFrame:
    """(doc, y0, y1, of, x0, x1, runs): chains of every document; y0..x1 are the word ranges to fetch.

    Ranges of earlier documents begin and end at multiples of BLOCK words, so that many chains
    share the few ranges of a passage that many documents hold.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def made(pdf: pd.DataFrame) -> pd.DataFrame:
            rows: list[tuple] = []
            if len(pdf):
                doc, of, at, of_at = (pdf[c].to_numpy().astype(np.int64) for c in ("doc", "of", "at", "of_at"))
                cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(of) != 0)) + 1).tolist(), len(doc)]
                for i, j in zip(cuts, cuts[1:]):
                    for c in chains_of(at[i:j], of_at[i:j]) if j > i else ():
                        y0, x0 = max(0, c[0][0] - PAD), max(0, c[0][1] - PAD) // BLOCK * BLOCK
                        y1, x1 = c[-1][0] + c[-1][2] + PAD, -(-(c[-1][1] + c[-1][2] + PAD) // BLOCK) * BLOCK
                        rows.append((int(doc[i]), y0, y1, int(of[i]), x0, x1, [v for y, x, n in c for v in (y - y0, x - x0, n)]))
            return pd.DataFrame(rows, columns=["doc", "y0", "y1", "of", "x0", "x1", "runs"])

        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(pdf):
                last = pdf["doc"].to_numpy() == pdf["doc"].iloc[-1]
                rest = pdf[last].reset_index(drop=True)
                yield made(pdf[~last])
        if rest is not None:
            yield made(rest)

    ordered = matches.repartition("doc").sortWithinPartitions("doc", "of", "at")
    return ordered.mapInPandas(run, "doc long, y0 int, y1 int, of long, x0 int, x1 int, runs array<int>")


def segments(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """The words of both sides of chains, cut from each text once.

    Rows with ``doc`` are chains with their own words; rows without are ranges (of, x0, x1)
    of earlier documents, each once. A document's list is bounded by its length: its own chains
    have a seed each, and its ranges begin and end at multiples of BLOCK.
    """
    theirs = chains.select(F.col("of").alias("id"), F.lit(None).cast("long").alias("other"), "x0", "x1", F.lit(0).alias("y0"), F.lit(0).alias("y1"), F.array().cast("array<int>").alias("runs")).distinct()
    mine = chains.select(F.col("doc").alias("id"), F.col("of").alias("other"), "x0", "x1", "y0", "y1", "runs")
    asked = mine.unionByName(theirs).groupBy("id").agg(F.collect_list(F.struct("other", "x0", "x1", "y0", "y1", "runs")).alias("asked"))
    names = ["doc", "of", "x0", "x1", "y0", "runs", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text, asked_of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = ascii_words(text.as_py())
                for r in asked_of.as_py():
                    own = r["other"] is not None
                    s, e = (r["y0"], r["y1"]) if own else (r["x0"], r["x1"])
                    part = b" ".join(words[s:e])
                    out.append((doc if own else None, r["other"] if own else doc, r["x0"], r["x1"], r["y0"], r["runs"], part))
                    size += len(part)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    joined = docs.join(asked.withColumnRenamed("id", "doc"), "doc").select("doc", "text", "asked")
    return joined.mapInArrow(run, "doc long, of long, x0 int, x1 int, y0 int, runs array<int>, words binary")


def common(a: list, b: list) -> int:
    """Words in common, in order."""
    if not a or not b:
        return 0
    if len(a) == len(b) and (same := sum(map(lambda p, q: p == q, a, b))) * 2 > len(a):
        return same
    row = [0] * (len(b) + 1)
    for p in a:
        old = 0
        for j, q in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if p == q else max(row[j], row[j - 1])
    return row[-1]


def grown(a: list, b: list) -> list[tuple[int, int, int]]:
    """Blocks (place in a, place in b, words) of equal words from the beginning of both lists on.

    Up to three differing words are passed over where AHEAD_EQUAL of the next AHEAD words are equal.
    """
    out, i, j = [], 0, 0
    while True:
        n = equal_words(a, b, i, j)
        if n:
            out.append((i, j, n))
        i, j = i + n, j + n
        for da, db in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (3, 3)):
            p, q = a[i + da : i + da + AHEAD], b[j + db : j + db + AHEAD]
            if p and q and p[0] == q[0] and sum(map(eq, p, q)) >= AHEAD_EQUAL:
                i, j = i + da, j + db
                break
        else:
            return out


def equal_words(a: list, b: list, i: int, j: int) -> int:
    """Length of the run of equal words that begins at a[i] and b[j]."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def grown_back(a: list, b: list) -> list[tuple[int, int, int]]:
    """As ``grown``, from the ends of both lists towards their beginnings."""
    return [(len(a) - i - n, len(b) - j - n, n) for i, j, n in grown(a[::-1], b[::-1])][::-1]


def exact_blocks(a: list, b: list, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The blocks of equal words of a chain's runs, each as long as the texts allow."""
    out: list[tuple[int, int, int]] = []
    for p, q, n in runs:
        if out and out[-1][0] - out[-1][1] == p - q and p + n <= out[-1][0] + out[-1][2]:
            continue
        while p and q and a[p - 1] == b[q - 1]:
            p, q, n = p - 1, q - 1, n + 1
        n += equal_words(a, b, p + n, q + n)
        if a[p : p + n] == b[q : q + n]:
            out.append((p, q, n))
            continue
        t = 0
        while t < n:
            k = equal_words(a, b, p + t, q + t)
            if k >= LEAST_BLOCK:
                out.append((p + t, q + t, k))
            t += k + 1
    return out


def aligned(a: list, b: list, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(start, end) in a, (start, end) in b and the identity of each passage of a chain.

    A chain is split at every gap of over GAP_EDITS differing words whose own identity is below
    IDENTITY, then at the gap of most differing words while a passage as a whole is below it. A
    passage of one block has no gap, so that no exact run is lost to its neighbours.
    """
    found = exact_blocks(a, b, runs)
    if not found:
        return []
    (p, q, _), (y, x, n) = found[0], found[-1]
    blocks = grown_back(a[:p], b[:q])
    for p, q, m in found:
        if blocks:
            i, j = blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]
            if p - i > GAP_EDITS and q - j > GAP_EDITS:
                ahead = [(i + u, j + v, w) for u, v, w in grown(a[i:p], b[j:q])]
                if ahead:
                    blocks += ahead
                    i, j = ahead[-1][0] + ahead[-1][2], ahead[-1][1] + ahead[-1][2]
                blocks += [(i + u, j + v, w) for u, v, w in grown_back(a[i:p], b[j:q])]
        blocks.append((p, q, m))
    blocks += [(y + n + u, x + n + v, w) for u, v, w in grown(a[y + n :], b[x + n :])]
    # Of each block but the first: words that the block before holds in either text, equal and differing words between.
    links = []
    for (p, q, m), (y, x, n) in zip(blocks, blocks[1:]):
        over = max(p + m - y, q + m - x, 0)
        between = a[p + m : y + over], b[q + m : x + over]
        same = common(*between)
        links.append((over, same, max(map(len, between)) - same))
    todo, out = [(0, len(blocks))], []
    while todo:
        lo, hi = todo.pop()
        inner = range(lo, hi - 1)
        worst = max(inner, key=lambda k: links[k][2], default=lo)
        bad = [k for k in inner if links[k][2] > GAP_EDITS and links[k][1] < IDENTITY * (links[k][1] + links[k][2])]
        if bad:
            worst = max(bad, key=lambda k: links[k][2])
        else:
            some = blocks[lo:hi]
            ends = max(p + n for p, _, n in some), max(q + n for _, q, n in some)
            starts = min(p for p, _, _ in some), min(q for _, q, _ in some)
            same = some[0][2] + sum(links[k][1] + max(0, blocks[k + 1][2] - links[k][0]) for k in inner)
            identity = same / max(ends[0] - starts[0], ends[1] - starts[1])
            if identity >= IDENTITY or hi - lo == 1:
                out.append((starts[0], ends[0], starts[1], ends[1], identity))
                continue
        todo += [(worst + 1, hi), (lo, worst + 1)]
    return out


def align(parts: DataFrame) -> DataFrame:
    """(doc, start, stop, of, of_start, of_stop, identity) of every chain's passages."""
    mine = parts.where("doc is not null").withColumnRenamed("words", "a")
    theirs = parts.where("doc is null").select("of", "x0", "x1", F.col("words").alias("b"))
    both = mine.join(theirs, ["of", "x0", "x1"]).select("doc", "y0", "of", "x0", "runs", "a", "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, y0, of, x0, runs, a, b in pdf.itertuples(index=False):
                triples = [tuple(int(v) for v in runs[i : i + 3]) for i in range(0, len(runs), 3)]
                rows += [(doc, y0 + s, y0 + e, of, x0 + t, x0 + u, same) for s, e, t, u, same in aligned(a.split(b" "), b.split(b" "), triples)]
            yield pd.DataFrame(rows, columns=["doc", "start", "stop", "of", "of_start", "of_stop", "identity"])

    return both.mapInPandas(run, "doc long, start int, stop int, of long, of_start int, of_stop int, identity double")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, stop, of, of_start, of_stop, identity): passages that an earlier document holds, as aligned.

    ``start`` and ``stop`` count words. A document's passages that overlap or touch make up
    one repeat; those whose union is shorter than MIN_WORDS are left out.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = texts.select("doc", F.xxhash64("text").alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"))
    several = hashed.where("n > 1").select("doc", F.col("a").alias("h"), (F.col("a") == F.col("b")).alias("same"))
    again = materialize(several, "again")
    if not again.isEmpty():
        # Repeated ids: one row for each where all texts agree, else none.
        once = texts.join(again.where("same").select("doc"), "doc", "left_semi").dropDuplicates(["doc"])
        texts = texts.join(again.select("doc"), "doc", "left_anti").unionByName(once)
    chains = materialize(chain(first_matches(seeds(texts))), "chains")  # read twice
    parts = materialize(segments(texts, chains), "segments")  # so that AQE can split a passage's key
    good = align(parts).where(F.col("identity") >= IDENTITY)
    return united(good)


def united(passages: DataFrame) -> DataFrame:
    """Passages of unions of MIN_WORDS words or more, without those that lie within another passage of the document."""
    order = Window.partitionBy("doc").orderBy("start", F.desc("stop"), "of", "of_start")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = passages.withColumn("before", before).where("before is null or before < stop")
    opened = outer.withColumn("new", F.when(F.col("before") >= F.col("start"), 0).otherwise(1))
    numbered = opened.withColumn("part", F.sum("new").over(order))
    whole = Window.partitionBy("doc", "part")
    length = F.max("stop").over(whole) - F.min("start").over(whole)
    return numbered.withColumn("length", length).where(F.col("length") >= MIN_WORDS).drop("before", "new", "part", "length")


def spans(passages: DataFrame) -> DataFrame:
    """(doc, spans, of_docs): a document's united spans and the earlier documents that hold them; at most some per 50 words."""
    listed = passages.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("all"), F.array_sort(F.collect_set("of")).alias("of_docs"))
    start = F.expr("cast(array() as array<struct<start:int,stop:int>>)")

    def merge(done, s):
        end = F.try_element_at(done, F.lit(-1))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        longer = F.concat(head, F.array(F.struct(end["start"].alias("start"), F.greatest(end["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (end["stop"] >= s["start"]), longer).otherwise(F.concat(done, F.array(s)))

    return listed.select("doc", F.aggregate("all", start, merge).alias("spans"), "of_docs")


def duplicated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_dup_words, n_spans, spans ("start-stop" in words), of_docs (earlier holders)."""
    found = spans(repeats(docs, id_col, text_col)).withColumnRenamed("doc", "doc_id")
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x09-\x0D\x20]+")).cast("long")
    all_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("n_words"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return all_docs.join(found, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce(total, F.lit(0)).alias("n_dup_words"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), F.array().cast("array<string>")).alias("spans"), F.coalesce("of_docs", F.array().cast("array<bigint>")).alias("of_docs"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` whose later copies of passages are cut from the text; ``chars_col``, where present, is counted anew."""
    found = spans(repeats(docs, id_col, text_col)).select(F.col("doc").alias(id_col), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["stop"]))).alias("_cuts"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([without_words(t, c) for t, c in zip(text, cuts)])

    # Several rows may share an id with different texts; those have no spans.
    touched = docs.join(found, id_col).withColumn(text_col, cut(text_col, "_cuts")).drop("_cuts")
    if chars_col in docs.columns:
        touched = touched.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return docs.join(found.select(id_col), id_col, "left_anti").unionByName(touched.select(*docs.columns))


def without_words(text: str | None, cuts) -> str | None:
    """A text less the word ranges in cuts (start, stop, start, stop ...), each with the space that follows it."""
    if text is None:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, last = [], 0
    for s, e in zip(cuts[::2], cuts[1::2]):
        out.append(raw[last : at[min(s, len(at) - 1)]])
        last = at[min(e, len(at) - 1)]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
