"""Sharding by longest-processing-time scheduling: groups that stay together, largest first,
go to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlens.sources.storage import cut_lineage

EXACT_BITS = 14  # group sizes below 2**14 bytes are classes of their own, larger ones keep 14 leading bits
CLASS_BUCKETS = 64  # parts in which the groups of one class are numbered
SLOT_BUCKETS = 1024  # parts in which the rows of one shard are numbered


def deal(sizes: Iterable[tuple[int, int]], loads: list[int]) -> dict[int, list[int]]:
    """Groups per shard for each ``(size, count)``, sizes descending; ``loads`` is brought up to date.

    Equal groups given one by one to the least-loaded shard begin at the ``count`` lowest of the
    loads ``L, L + size, L + 2 size, ...`` of all shards. So all but the last few of them are
    counted at once, by the level they fill; the rest goes through the heap.
    """
    plan = {}
    for size, count in sizes:
        got = [0] * len(loads)
        low, high = min(loads), max(loads) + size * (count // len(loads) + 1)
        while high - low > 1 and count > 4 * len(loads):
            level = (low + high) // 2
            if sum(max(0, -((load - level) // size)) for load in loads) <= count:
                low = level
            else:
                high = level
        if count > 4 * len(loads):
            got = [max(0, -((load - low) // size)) for load in loads]
        heap = [(load + n * size, k) for k, (load, n) in enumerate(zip(loads, got))]
        heapq.heapify(heap)
        for _ in range(count - sum(got)):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            got[k] += 1
        for k, n in enumerate(got):
            loads[k] += n * size
        plan[size] = got
    return plan


def _plan_frame(spark: SparkSession, plan: dict[int, list[int]]) -> DataFrame:
    rows = [(size, np.cumsum(got).tolist()) for size, got in plan.items()]
    return spark.createDataFrame(rows, "class long, upto array<long>")


def _numbered(df: DataFrame, key: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0. Buckets of a key are numbered apart and set off by the
    counts of the buckets before them, so that no task sorts a whole key."""
    df = df.withColumn("bucket", bucket)
    ahead = (
        df.groupBy(key, "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("ahead", F.sum("n").over(Window.partitionBy(key).orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    own = Window.partitionBy(key, "bucket").orderBy(*order)
    return (
        df.withColumn(name, F.row_number().over(own) - 1)
        .join(ahead, [key, "bucket"])
        .withColumn(name, (F.col(name) + F.col("ahead")).cast("long"))
        .drop("bucket", "ahead")
    )


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard``. The law is ``bytes``.

    Size is the UTF-8 length of the text plus 1. Rows with equal texts form one group and stay in
    one shard; a null text counts as empty. Groups are dealt largest first, each
    to the least-loaded shard. ``slot`` numbers the rows of a shard from 0. Adding a shard moves
    groups at will under this law, so ``grown_shard`` is null.

    The driver sees only how many groups there are of each size: exact below 2**14 bytes, by 14
    leading bits above, so at most 2**14 + 2**13 for each further doubling, whatever the data.
    Large groups are dealt first; their exact loads are then summed and small groups, in exact
    sizes, level them out. Texts are hashed where they are read (128 bits) and never move.

    Repeated rows are rows of their own in the same shard; null ids are kept. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(7), text).alias("h2"),
    )
    bits = F.greatest(F.length(F.bin("bytes")) - EXACT_BITS, F.lit(0))
    groups = cut_lineage(
        rows.groupBy("size", "h1", "h2")
        .agg(F.count("*").alias("copies"))
        .withColumn("bytes", F.col("size") * F.col("copies"))
        .withColumn("bits", bits)
        .withColumn("class", F.expr("shiftleft(shiftright(bytes, bits), bits)"))
    )
    counts = sorted(
        ((r["class"], r["n"], r["bits"]) for r in groups.groupBy("class", "bits").agg(F.count("*").alias("n")).toLocalIterator()),
        reverse=True,
    )
    ranked = _numbered(
        groups, "class", F.pmod(F.col("h1"), F.lit(CLASS_BUCKETS)), ["h1", "h2", "size"], "rank"
    )

    def assigned(plan: dict[int, list[int]], large: bool) -> DataFrame:
        # the plan has at most one row for each size class: bounded as said above
        return (
            ranked.where((F.col("bits") > 0) == F.lit(large))
            .join(F.broadcast(_plan_frame(spark, plan)), "class")
            .withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("rank"))))
            .select("size", "h1", "h2", "bytes", "shard")
        )

    loads = [0] * shards
    large = assigned(deal([(c, n) for c, n, b in counts if b], loads), True)
    large = cut_lineage(large)
    loads = [0] * shards
    for r in large.groupBy("shard").agg(F.sum("bytes").alias("load")).collect():
        loads[r["shard"]] = r["load"]
    small = assigned(deal([(c, n) for c, n, b in counts if not b], loads), False)
    places = large.unionByName(small).drop("bytes")
    placed = cut_lineage(rows.join(places, ["size", "h1", "h2"]).select("doc_id", "size", "text_crc32", "shard"))
    slots = _numbered(
        placed,
        "shard",
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)),
        ["doc_id", "text_crc32", "size"],
        "slot",
    )
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
