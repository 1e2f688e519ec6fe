"""Finding the groups that are too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import DataFrame, functions as F

# A group up to this many rows may be sorted inside one task.
HOT_GROUP_ROWS = 1_000_000
# A frame of keys up to this many rows may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_KEY_ROWS = 100_000
# Rows of ordinary groups that one task sorts, where the session's number of shuffle partitions allows more.
TASK_ROWS = 250_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join where null keys match; key columns of ``right`` are dropped."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    on = reduce(and_, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def bounded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast after counting, and only within the bound; the count stops just past it."""
    if rows is None:
        rows = df.limit(BROADCAST_KEY_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_KEY_ROWS else df


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group, pre-aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as ``rows`` need, at least those a shuffle has.

    The windows and aggregates by these keys that follow take these partitions as they are.
    """
    parts = ceil(rows / TASK_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if parts > usual else df.repartition(*keys)


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    *,
    limit: int = HOT_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of groups over ``limit`` or None).

    Runs one job over the key columns. ``sizes`` (keys and ``_n``) replaces the count
    where a cheaper way to it is known. No row is dropped. Rows of ordinary groups are dealt by
    ``keys``, so that what a task holds does not grow with the table.
    """
    sizes = group_sizes(df, keys) if sizes is None else sizes
    over = F.col("_n") > limit
    found, rest = sizes.agg(F.count_if(over), F.coalesce(F.sum(F.when(~over, F.col("_n"))), F.lit(0))).first()
    if found == 0:
        return dealt(df, keys, rest), None
    marked = bounded_broadcast(sizes.filter(over).select(*keys), found)
    return (
        dealt(join_null_safe(df, marked, keys, "left_anti"), keys, rest),
        join_null_safe(df, marked, keys, "left_semi"),
    )
