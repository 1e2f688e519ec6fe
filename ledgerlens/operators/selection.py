"""Exact prefixes of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.operators.ranks import number_rows
from ledgerlens.operators.skew import HOT_GROUP_ROWS, split_hot


def hash_order(*cols: Column) -> Column:
    """A reproducible shuffle order: the first 13 hex digits of md5, exact as a double."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def mark_prefix(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    tie: Sequence[str],
    *,
    wanted: Column,
    name: str = "selected",
    limit: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add ``name``: whether the row is among the first ``wanted`` of its group.

    Order is ascending ``value`` (nulls last), then ``hash_order(tie)``, then ``tie``.
    ``wanted`` may use ``_size``, the size of the group. With no keys the frame is one group.
    Where only some of several rows equal in all of that fit, any of them are taken.

    Groups of at most ``limit`` rows are sorted by a window; larger ones, and the whole frame, are
    numbered across partitions.
    """
    ties = {f"_t{i}": F.col(t) for i, t in enumerate(tie)}
    ready = df.withColumns(
        {
            "_v": F.coalesce(value.cast("double"), F.lit(float("inf"))),
            "_h": hash_order(*[F.col(t) for t in tie]),
            **ties,
        }
    )
    order = ["_v", "_h", *ties]
    cold, hot = split_hot(ready, keys, limit=limit) if keys else (None, ready)
    parts = []
    if cold is not None:
        group = Window.partitionBy(*keys)
        place = F.row_number().over(group.orderBy(*order))
        parts.append(cold.withColumns({"_place": place, "_size": F.count(F.lit(1)).over(group)}))
    if hot is not None:
        parts.append(number_rows(hot, keys, order, rank="_place", size="_size"))
    marked = [p.select(*df.columns, (F.col("_place") <= wanted).alias(name)) for p in parts]
    return reduce(DataFrame.unionByName, marked)


def fraction_of_group(fraction: float) -> Column:
    """floor(size * fraction), for ``wanted``."""
    return F.floor(F.col("_size") * F.lit(float(fraction)))
