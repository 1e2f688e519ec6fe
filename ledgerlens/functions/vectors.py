"""Fixed-length vector expressions over named columns.

They are unrolled by position, so that they stay inside generated code, and built as SQL
text, so that building one is a single call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.cleaning import to_number

EPS = 1e-12


def _each(width: int, pattern: str, join: str = ", ") -> str:
    return join.join(pattern.format(i=i) for i in range(width))


def _at(name: str) -> str:
    return f"cast({name}[{{i}}] as double)"


def vector_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """Array of numbers; text that is no number, null and a missing column are 0."""
    known = set(df.columns)
    return F.array(*[to_number(F.col(c), 0) if c in known else F.lit(0.0) for c in columns])


def dot(a: str, b: str, width: int) -> Column:
    return F.expr(_each(width, f"{_at(a)} * {_at(b)}", " + "))


def length(a: str, width: int) -> Column:
    """Euclidean length, never below ``EPS``."""
    return F.greatest(F.sqrt(dot(a, a, width)), F.lit(EPS))


def divided(a: str, by: str, width: int) -> Column:
    return F.expr(f"array({_each(width, f'{_at(a)} / {by}')})")


def mean_vector(a: str, width: int, *, by: str = "1") -> Column:
    """Aggregate: the mean of each position, after dividing by ``by``."""
    return F.expr(f"array({_each(width, f'avg({_at(a)} / {by})')})")


def std_vector(a: str, width: int) -> Column:
    """Aggregate: population standard deviation of each position."""
    return F.expr(f"array({_each(width, f'stddev_pop({_at(a)})')})")


def scaled(a: str, mean: str, std: str, width: int) -> Column:
    """(x - mean) / std by position; a position without spread is divided by one."""
    spread = f"if({std}[{{i}}] > 0, {std}[{{i}}], 1.0D)"
    return F.expr(f"array({_each(width, f'({_at(a)} - {mean}[{{i}}]) / {spread}')})")


def with_unit(df: DataFrame, column: str, width: int, *, name: str) -> DataFrame:
    """Add the vector of length one; a zero vector stays zero."""
    sized = df.withColumn("_len", length(column, width))
    return sized.withColumn(name, divided(column, "_len", width)).drop("_len")


def to_unit_interval(similarity: Column) -> Column:
    """Cosine in [-1, 1] to a score in [0, 1], three decimals."""
    return F.round((similarity + 1) / 2, 3)
