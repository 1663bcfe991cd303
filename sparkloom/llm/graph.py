"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in a link; the component is its smallest node.

    Each round replaces every node's links to larger neighbours by links from those to the
    smallest neighbour, then the same for smaller ones, until nothing changes: a few rounds,
    as many as the logarithm of the longest path. Minima are aggregated before the shuffle
    and a node with very many links is a skewed join key, which AQE splits. Null ends and
    self links are ignored; repeated links count once. Every round is written to the shared
    folder, so lost executors cost one round at most.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialize(edges.select(high.alias("u"), low.alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that their join meets two plain exchanges and a star's key can be split.
        small = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "minima")
        large = both.join(small, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        small = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        joined = large.join(small, "u")
        stars = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stars.unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(stars, "links")
        new = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first()
        if new == state:
            break
        state = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
