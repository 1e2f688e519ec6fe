"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.sources.storage import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not the smallest of its component.

    ``edges`` has two long columns, ``a`` and ``b``. Alternating stars: each node hands its larger
    neighbours, then all its smaller ones, to its smallest neighbour, until nothing changes; that
    takes a number of rounds that grows with the logarithm of the diameter. A hub is only ever
    met in a partial aggregate and in a join that adaptive execution can split.
    """
    e = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
