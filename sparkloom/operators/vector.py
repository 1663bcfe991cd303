"""Dense search: exact nearest neighbours by cosine distance, on arrays of floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

#: Query vectors compared in one pass (8 bytes x dimensions each), all that driver and tasks hold; more go in further passes.
QUERY_BLOCK = 8_192
#: Queries and rows whose distances a task holds at once (8 bytes a pair).
QUERIES, ROWS = 512, 2_048


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero or the lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def normalized(v: Column, dims: int | None = None) -> Column:
    """The first ``dims`` elements at unit length; a zero vector stays as it is."""
    cut = F.slice(v, 1, dims) if dims else v
    n = norm(cut)
    return F.transform(cut, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, vec_id, rank, distance): the k rows of least cosine distance to each query, ties by id.

    Queries are dealt by hash in blocks of about ``QUERY_BLOCK`` (their number is checked first). A block at a time is held by the
    driver and broadcast; every task keeps its k best per query (16 bytes each) and the distances of some queries to some rows, so that
    its memory doesn't grow with the input, and a pass shuffles k rows per query and task, never a row per pair. Of several blocks each one's result is kept before the next is read. Rows without a
    vector or with a zero one are left out.
    """
    fields = vectors.schema
    id_type = fields[id_col].dataType.simpleString()
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v"))
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    schema = f"query_id {id_type}, vec_id {id_type}, distance double"
    context = vectors.sparkSession.sparkContext
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    found = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = rows.mapInPandas(_best(context.broadcast(_unit_block(mine)), k, exclude_self), schema)
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if blocks > 1:
            part = kept(part)
            part.count()
        found = part if found is None else found.unionByName(part)
    return found


def _unit_block(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one block at unit length and their ids; zero vectors are left out."""
    got = queries.toPandas()
    q = np.stack(got["v"].map(lambda v: np.asarray(v, float)).to_list()) if len(got) else np.zeros((0, 1))
    length = np.linalg.norm(q, axis=1)
    return q[length > 0] / length[length > 0][:, None], got["query_id"].to_numpy()[length > 0]


def _best(block, k: int, exclude_self: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names = block.value
        ids, dist = np.zeros((len(q), k), np.int64), np.full((len(q), k), np.inf)
        for pdf in frames:
            if not len(q) or not len(pdf):
                continue
            x = np.stack(pdf["v"].map(lambda v: np.asarray(v, float)).to_list())
            length = np.linalg.norm(x, axis=1)
            good = length > 0
            x, own = x[good] / length[good][:, None], pdf["vec_id"].to_numpy()[good]
            for i in range(0, len(x), ROWS):
                for j in range(0, len(q), QUERIES):
                    d = np.round(1 - q[j : j + QUERIES] @ x[i : i + ROWS].T, 9) + 0.0
                    if exclude_self:
                        d[names[j : j + QUERIES, None] == own[None, i : i + ROWS]] = np.inf
                    merge(ids[j : j + QUERIES], dist[j : j + QUERIES], d, own[i : i + ROWS], k)
        keep = np.isfinite(dist)
        for j in range(0, len(q), QUERIES):
            mine = keep[j : j + QUERIES]
            yield pd.DataFrame({"query_id": np.repeat(names[j : j + QUERIES], mine.sum(1)), "vec_id": ids[j : j + QUERIES][mine], "distance": dist[j : j + QUERIES][mine]})

    return run


def merge(ids: np.ndarray, dist: np.ndarray, d: np.ndarray, own: np.ndarray, k: int) -> None:
    """Put the distances ``d`` of rows ``own`` among each query's k best, in place; only those up to the k-th best so far are sorted."""
    most = dist[:, -1]
    if d.shape[1] > k:
        most = np.fmin(most, np.partition(d, k - 1, axis=1)[:, k - 1])
    at, col = np.nonzero((d <= most[:, None]) & np.isfinite(d))
    changed = np.unique(at)
    if not len(changed):
        return
    place = np.concatenate([at, np.repeat(changed, k)])
    all_ids, all_dist = np.concatenate([own[col], ids[changed].ravel()]), np.concatenate([d[at, col], dist[changed].ravel()])
    order = np.lexsort((all_ids, all_dist, place))
    starts = np.searchsorted(place[order], changed)
    best = order[starts[:, None] + np.arange(k)]
    ids[changed], dist[changed] = all_ids[best], all_dist[best]
