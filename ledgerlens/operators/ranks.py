"""Exact ranks inside groups of any size, without bringing a group together.

Rows are dealt over the cluster by ranges of (key, order), so a large group covers several
neighbouring partitions and many small groups share one. One pass over each sorted partition
numbers the groups that lie inside it. Only the groups at its two ends, which may go on next door,
are left open: their rows per partition are counted, and these few counts give every part of such
a group its offset. One path serves every group size. Rows equal in key and order are dealt by a
number of their own, so a value that most rows share spreads like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructType

from ledgerlens.sources.storage import scratch_path

# monotonically_increasing_id keeps the place inside a partition in its lower bits.
_PLACE_BITS = 33
# A group that is still open after so many rows is left to the counts, like those at the ends.
OPEN_ROWS = 500_000


def _with(batch: pa.RecordBatch, rank: np.ndarray | None, size: np.ndarray | None) -> pa.RecordBatch:
    n = batch.num_rows
    extra = [pa.nulls(n, pa.int64()) if a is None else pa.array(a, pa.int64()) for a in (rank, size)]
    return pa.RecordBatch.from_arrays([*batch.columns[:-2], *extra], [*batch.schema.names[:-2], "_rank", "_size"])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank and size for rows of groups that begin and end in this partition, null for others. The
    last two columns tell the groups apart."""
    held: list[pa.RecordBatch] = []  # rows of the group that is open
    key, rows, known = None, 0, False

    def close() -> Iterator[pa.RecordBatch]:
        done = 0
        for part in held:
            n = part.num_rows
            if known:
                yield _with(part, np.arange(done, done + n) + 1, np.full(n, rows))
            else:
                yield _with(part, None, None)
            done += n
        held.clear()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (np.asarray(batch.column(batch.num_columns - i)) for i in (2, 1))
        starts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        same = key == (a[0], b[0])
        if key is not None and not same:
            yield from close()
            rows, known = 0, True
        first = int(starts[0]) if len(starts) else n
        held.append(batch.slice(0, first))
        rows += first
        if len(starts):
            yield from close()
            last = int(starts[-1])
            sizes = np.diff(starts)
            if last > first:
                rank = np.arange(first, last) - np.repeat(starts[:-1], sizes) + 1
                yield _with(batch.slice(first, last - first), rank, np.repeat(sizes, sizes))
            held.append(batch.slice(last))
            rows, known = n - last, True
        key = (a[-1], b[-1])
        if rows > OPEN_ROWS:
            known = False
            yield from close()
    known = False  # it may go on in the next partition
    yield from close()


def _placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_at``, which rises in the order of key and ``order`` (nulls first), and with
    ``_rank`` and ``_size`` where one partition tells them. Written once, as the counts and the rows
    have to see the same places."""
    by = [*keys, *order, "_salt"]
    path = scratch_path(rows.sparkSession, "ranks")
    mark = list(keys) or [F.lit(0)]
    spread = (
        rows.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_salt")
        .withColumn("_at", F.monotonically_increasing_id())
        # 96 bits tell a key from its neighbours
        .withColumns({"_a": F.xxhash64(*mark, *[F.col(k).isNull() for k in keys]), "_b": F.hash(*mark)})
    )
    kinds = StructType([*spread.schema.fields[:-2]]).add("_rank", LongType()).add("_size", LongType())
    spread.mapInArrow(_number, kinds).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, rank: str = "rank", size: str = "size"
) -> DataFrame:
    """Add each row's 1-based ``rank`` in its group by ``order`` and the ``size`` of the group.

    Null keys form a group; nulls come first in the order; rows equal in all order columns get
    neighbouring ranks in no particular order. With no keys the frame is one group.

    Rows move once. The counts that are broadcast are at most a few for each partition: its first
    and last group, and those of over ``OPEN_ROWS`` rows.
    """
    placed = _placed(df, keys, order)
    cell = F.shiftright("_at", _PLACE_BITS)
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    cells = (
        placed.where("_rank is null")
        .groupBy(*[F.col(k).alias(n) for k, n in names.items()], cell.alias("_cell"))
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    group = Window.partitionBy(*names.values())
    cells = cells.withColumns(
        {"_before": F.sum("_n").over(group.orderBy("_cell")) - F.col("_n"), "_whole": F.sum("_n").over(group)}
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], cell == F.col("_cell"))
    both = placed.join(F.broadcast(cells.drop("_n")), on, "left")
    return both.select(
        *df.columns,
        F.coalesce("_rank", F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(rank),
        F.coalesce("_size", "_whole").alias(size),
    )


def rows_at(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Mapping[str, Column]
) -> DataFrame:
    """The rows at chosen ranks: keys, ``which``, the order columns, ``_size``.

    ``wanted`` names 1-based ranks as expressions over ``_size``; a rank outside the group
    gives no row. All ranks of all groups are picked in one pass.
    """
    numbered = number_rows(df.select(*keys, *order), keys, order, rank="_place", size="_size")
    hits = {n: F.col("_place") == c.cast("long") for n, c in wanted.items()}
    names = F.filter(F.array(*[F.when(h, F.lit(n)) for n, h in hits.items()]), lambda n: n.isNotNull())
    found = numbered.where(reduce(or_, hits.values()))
    return found.select(*keys, F.explode(names).alias("which"), *order, "_size")


def quantiles(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles of several values: keys, ``measure`` and one column per prob.

    Only keys and non-null numbers move. A group without a value has no row.
    """
    cells = [F.struct(F.lit(i).alias("_m"), c.cast("double").alias("_v")) for i, c in enumerate(values.values())]
    slim = df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c._m", "_c._v")
    by = [*keys, "_m"]
    # Dealing rows by ranges reads them twice, once for a sample; a long plan is better run once.
    path = scratch_path(df.sparkSession, "values")
    slim.where("_v is not null").write.parquet(path)
    numbered = number_rows(df.sparkSession.read.parquet(path), by, ["_v"], rank="_place", size="_size")
    picks, near = [], []
    for n, p in probs.items():
        place = F.lit(float(p)) * (F.col("_size") - 1)
        low, part = F.floor(place), place - F.floor(place)
        # the value at the lower rank and, beyond it, a part of the step to the next one
        here, above = F.col("_place") == low + 1, F.col("_place") == low + 2
        near += [here, above]
        lo, hi = F.max(F.when(here, F.col("_v"))), F.max(F.when(above, F.col("_v")))
        picks.append((lo + F.coalesce(hi - lo, F.lit(0.0)) * F.max(part)).alias(n))
    names = F.array(*[F.lit(n) for n in values])
    found = numbered.where(reduce(or_, near)).groupBy(*by).agg(*picks)
    return found.select(*keys, F.get(names, F.col("_m")).alias("measure"), *probs)
