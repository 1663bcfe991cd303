"""Operator 4, document fingerprints: one-permutation MinHash with optimal densification.

Each distinct five-word shingle (fewer words: all of them) is hashed once; the top eight
bits choose one of 256 bins, which keeps its smallest hash. An empty bin borrows the value
of the first filled bin on a probe sequence of its own (one 2-universal hash per attempt),
the same for all texts. Stored are the low four bits of every bin, packed; likeness is the
share of equal bins, corrected for the chance agreement of four bits.

Scale: fingerprints are made where the rows are read. The pairs with the next document need
one range exchange of the texts; ids are cut into ranges and only the one document at each
range's edge is sent twice.

Defined cases: null text is empty; a text without words has the fingerprint of no shingles
(all zeros, marked by a leading ``-`` so that it equals no other), likeness 1 to another such,
0 to all else; the order is doc_id, then text, descending, nulls last; repeated rows count
as rows of their own; a table of one row is its own next document; empty gives empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .simhash import shingle_hashes

BINS, BITS, SHINGLE = 256, 4, 5
ATTEMPTS = 4096
PRIME = (1 << 31) - 1


def probes() -> np.ndarray:
    """The bins that an empty bin asks, attempt by attempt: (a * bin + b) mod p mod BINS, a and b drawn per attempt."""
    rng = np.random.default_rng(2017)
    a, b = rng.integers(1, PRIME, (2, ATTEMPTS), dtype=np.int64)
    return ((np.arange(BINS)[:, None] * a + b) % PRIME % BINS).astype(np.int16)


PROBES = probes()


def sketch(text: str | None) -> np.ndarray | None:
    """The low bits of the densified bins; None for a text without words."""
    h = shingle_hashes(text, SHINGLE)
    if not len(h):
        return None
    h = np.sort(h)
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.append(0, np.flatnonzero(np.diff(bins)) + 1)
    values, filled = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    values[bins[first]] = (h[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    source = np.arange(BINS)
    if len(first) == 1:
        source[:] = bins[0]
    else:
        step, at = 16, 0
        while len(empty) and at < ATTEMPTS:
            asked = PROBES[empty, at : at + step]
            got = filled[asked]
            done = got.any(1)
            source[empty[done]] = asked[done, got[done].argmax(1)]
            empty, at = empty[~done], at + step
        source[empty] = bins[0]  # all attempts failed: the first filled bin
    return values[source]


def spelled(values: np.ndarray | None) -> str:
    """Packed low bits as hexadecimal digits, one per bin."""
    if values is None:
        return "-" + "0" * BINS
    return np.packbits(np.unpackbits(values[:, None], axis=1)[:, 8 - BITS :].ravel()).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: the share of equal bins, less what BITS bits agree in by chance."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return float(max(0.0, ((a == b).mean() - chance) / (1 - chance)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: each row with the next row's text by descending id; the last gets the first's."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(rows.select(order.cast("double").alias("o")).approxQuantile("o", [i / parts for i in range(1, parts)], 0.25 / parts)))
    # The part of an id: how many edges lie below it.
    part = F.lit(0)
    if edges:
        bounds = F.array(*(F.lit(e) for e in edges))
        part = F.aggregate(bounds, F.lit(0), lambda n, e: n + F.when(e < F.col("o"), 1).otherwise(0))
    dealt = rows.withColumn("o", order.cast("double")).withColumn("part", part)
    # Each part's first row (largest id) also follows the last row of the part above; one row a part.
    keyed = dealt.withColumn("k", order)
    ends = F.broadcast(keyed.groupBy("part").agg(F.max("k").alias("k")))
    tops = keyed.select("part", "k", "text").join(ends, ["part", "k"]).groupBy("part", "k").agg(F.max("text").alias("text"))
    above = Window.orderBy("part")
    copies = tops.select(F.coalesce(F.lead("part").over(above), F.min("part").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"), F.col("k"), "text", F.lit(1).alias("extra"))
    mine = dealt.select("part", order.alias("k"), "text", F.lit(0).alias("extra"), "doc_id")
    both = mine.unionByName(copies.withColumn("doc_id", F.lit(None).cast("long")))
    sequence = Window.partitionBy("part").orderBy("extra", F.desc("k"), F.desc("text"))
    return both.withColumn("next_text", F.lead("text").over(sequence)).where("extra = 0").select("doc_id", "text", "next_text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third replaced by the next one's start)."""
    n, third = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs, id_col, text_col).select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), "text", edited.alias("edited"), "next_text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            last: tuple = (None, None)  # a row's next text is mostly the following row's own text
            for text, edited_text, following in zip(*(batch.column(i) for i in (3, 4, 5))):
                text, edited_text, following = text.as_py(), edited_text.as_py(), following.as_py()
                mine = last[1] if last[0] == text else sketch(text)
                other, nxt = sketch(edited_text), sketch(following)
                last = (following, nxt)
                out.append((spelled(mine), spelled(other), likeness(mine, other), likeness(mine, nxt)))
            made = zip(*out) if out else ((),) * 4
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(made, kinds))], names=names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the packed fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [spelled(sketch(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")
