"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
WHITE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
BATCH_BYTES = 8_000_000  # of text that one vectorised step works on


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def stripped(col: Column) -> Column:
    return F.trim(col, F.lit(WHITE))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(col.cast("string")) % n


def map_texts(
    df: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    limit: int = BATCH_BYTES,
) -> DataFrame:
    """``mapInArrow`` over record batches of bounded size in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(small_batches(batches, limit))

    return df.mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
