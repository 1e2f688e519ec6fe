"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.sources.storage import cut_lineage

SEGMENTS, WIDTH = 4, 16
CHUNK_CODES = 1024  # codes of one bucket that lie in one row
HELD_ROWS = 500_000  # verified codes that a worker holds
PROBE_CELLS = 4_000_000  # pairs of query and segment value that are looked at together
ID_PARTS = 64  # parts in which the ids of one code are ordered first


def sign_code(vector: Column) -> Column:
    """64-bit code: bit i is set if component i is 0 or more. Null for a null vector."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when(F.get(vector, i) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    return F.when(vector.isNotNull(), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _segments(code: str) -> Column:
    part = [
        F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(code, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int").alias("value"))
        for s in range(SEGMENTS)
    ]
    return F.explode(F.array(*part))


def _probes(queries: DataFrame, occupied: list[np.ndarray], radius: int) -> DataFrame:
    """``q, bound, seg, value``: occupied values at exactly this distance from the query's segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s, values in enumerate(occupied):
                step = max(1, PROBE_CELLS // max(len(values), 1))
                for at in range(0, len(codes), step):
                    own = (codes[at : at + step].view(np.uint64) >> np.uint64(WIDTH * s)).astype(np.uint16)
                    q, near = np.nonzero(np.bitwise_count(own[:, None] ^ values) == radius)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(codes[at + q]),
                            pa.array(bounds[at + q]),
                            pa.array(np.full(len(q), s, np.int32)),
                            pa.array(values[near].astype(np.int32)),
                        ],
                        ["q", "bound", "seg", "value"],
                    )

    return queries.select("q", "bound").mapInArrow(work, "q long, bound int, seg int, value int")


def _least(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` codes of each query among the rows read, a code once. About ``HELD_ROWS`` rows are
    held at a time; what is held then may be given out before all rows are read."""

    def best(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        q, code, first, held, d = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((code, first, d, q))
        q, code, first, held, d = (x[order] for x in (q, code, first, held, d))
        new = np.ones(len(q), bool)  # a code may be met in several segments
        new[1:] = (q[1:] != q[:-1]) | (code[1:] != code[:-1])
        q, code, first, held, d = (x[new] for x in (q, code, first, held, d))
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        return [x[rank < k] for x in (q, code, first, held, d)]

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["q", "code", "first", "held", "distance"])

    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if n >= HELD_ROWS:
            parts = [best(parts)]
            n = len(parts[0][0])
            if n > HELD_ROWS // 2:
                yield out(parts[0])
                parts, n = [], 0
    if parts:
        yield out(best(parts))


def _verified(met: DataFrame, k: int) -> DataFrame:
    """``q, code, first, held, distance``: of ``q, bound, entries``, true distances of the codes in the
    buckets met, none beyond the bound of its query, and few more than the best ``k`` of each query.

    Codes beyond the bound are dropped and buckets unfolded before Python sees them, as buckets of
    thousands of codes in batches of thousands of rows would not fit a worker."""

    def far(code: Column) -> Column:
        return F.bit_count(code.bitwiseXOR(F.col("q"))).cast("int")

    near = F.filter("entries", lambda e: far(e["code"]) <= F.col("bound"))
    near = met.select("q", F.inline(near)).withColumn("distance", far(F.col("code")))
    schema = "q long, code long, first long, held int, distance int"
    return near.select("q", "code", "first", "held", "distance").mapInArrow(lambda batches: _least(batches, k), schema)


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` nearest rows of ``base`` for each query row.

    Both tables have a long id and a 64-bit code. Order is by Hamming distance, then id. Codes are
    cut in four segments of 16 bits, each with an index. Round r looks up the segment values at
    distance r from the query's; after it every code within 4 r + 3 bits has been seen, so a query
    is done once its k-th verified distance is no more than that. Only open queries go on.

    Equal codes are one index entry with its ``k`` smallest ids. Buckets are cut in rows of at
    most ``CHUNK_CODES`` codes. The only thing sent to all tasks is which values of a segment
    occur, at most 65,536 each.

    Rows without code or id are neither found nor answered. Ties go to the smaller id. Repeated
    rows count as often as they occur. Fewer than ``k`` rows in ``base`` give as many answers.
    Empty tables give an empty result. Other columns are not read.
    """
    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code")).dropna()
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(code_col).cast("long").alias("q")).dropna()
    parts = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(ID_PARTS)))
    few = parts.withColumn("n", F.row_number().over(Window.partitionBy("code", "part").orderBy("id"))).where(F.col("n") <= k)
    ids = cut_lineage(
        few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k).select("code", "id", "n")
    )
    codes = ids.groupBy("code").agg(F.min("id").alias("first"), F.max("n").cast("int").alias("held"))
    total = codes.count()
    placed = codes.select("code", "first", "held", _segments("code").alias("s")).select("code", "first", "held", "s.*")
    # at most 4 x 65,536 rows
    sizes = cut_lineage(placed.groupBy("seg", "value").agg(F.ceil(F.count("*") / CHUNK_CODES).cast("int").alias("chunks")))
    occupied = [np.empty(0, np.uint16)] * SEGMENTS
    held = sizes.select("seg", "value").toPandas()
    for s in range(SEGMENTS):
        occupied[s] = np.sort(held["value"][held["seg"] == s].to_numpy().astype(np.uint16))
    index = cut_lineage(
        placed.join(F.broadcast(sizes), ["seg", "value"])
        .groupBy("seg", "value", F.pmod(F.xxhash64("code"), F.col("chunks")).alias("chunk"))
        .agg(F.collect_list(F.struct("code", "first", "held")).alias("entries"))
        .select("seg", "value", "entries")
    )
    open_ = cut_lineage(asked.select("q").distinct().withColumn("bound", F.lit(64)))
    best = answers = None
    for radius in range(WIDTH + 1):
        # the side whose rows of one key are buffered is that of the probes, which are small
        met = index.join(_probes(open_, occupied, radius), ["seg", "value"])
        seen = _verified(met, k)
        if best is not None:
            seen = seen.unionByName(best)
        seen = seen.dropDuplicates(["q", "code"])
        order = Window.partitionBy("q").orderBy("distance", "first")
        ranked = seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
        best = cut_lineage(ranked)
        # the k-th row's distance: the first at which the codes so far hold k rows
        upto = F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, 0))
        state = (
            best.withColumn("upto", upto)
            .groupBy("q")
            .agg(F.min(F.when(F.col("upto") >= k, F.col("distance"))).alias("kth"), F.count("*").alias("found"))
        )
        covered = SEGMENTS * (radius + 1) - 1
        judged = cut_lineage(
            open_.drop("bound")
            .join(state, "q", "left")
            .select(
                "q",
                F.coalesce("kth", F.lit(64)).alias("bound"),
                (F.coalesce(F.col("kth") <= covered, F.lit(False)) | (F.coalesce("found", F.lit(0)) >= total) | F.lit(radius == WIDTH)).alias("done"),
            )
        )
        ready = best.join(judged.where("done"), "q", "left_semi")
        answers = ready if answers is None else answers.unionByName(ready)
        open_ = cut_lineage(judged.where("not done").select("q", "bound"))
        if open_.isEmpty():
            break
        best = best.join(open_, "q", "left_semi")
    order = Window.partitionBy("q").orderBy("distance", "id")
    listed = (
        answers.join(ids, "code")
        .select("q", "id", "distance")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    return asked.join(listed, "q").select("query_id", "rank", "id", "distance")
