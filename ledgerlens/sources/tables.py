"""Table scans and sinks for delimited text, CSV and parquet."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerlens.functions.cleaning import parse_yymmdd, parse_yymmdd_ts, to_number
from ledgerlens.sources.schemas import BANK_TABLES, KEY_COLUMNS, SCORING_EVENT, TABLES


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip white space around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


# No field is spelled so; as the null value it lets the reader tell a quoted empty text from null.
KEEP_EMPTY = {"nullValue": "\0", "emptyValue": ""}


def scan_text(spark: SparkSession, path: str, *, sep: str = ";", keep_empty: bool = False) -> DataFrame:
    """Delimited text with a header; every column stays a string.

    An empty field is null; with ``keep_empty`` a quoted one is an empty text.
    """
    reader = spark.read.option("sep", sep).option("quote", '"').option("header", True)
    return trim_headers(reader.options(**(KEEP_EMPTY if keep_empty else {})).csv(path))


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``; text that does not fit a type becomes null."""
    return df.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def scan_typed(
    spark: SparkSession, path: str, schema: T.StructType, *, sep: str = ";", keep_empty: bool = False
) -> DataFrame:
    """Delimited text with a header, columns taken by name and cast to a fixed schema.

    Bad fields and columns the file does not have are null; a file without a key column of the
    schema has another layout and is refused.
    """
    return by_header(scan_text(spark, path, sep=sep, keep_empty=keep_empty), schema)


def missing_keys(df: DataFrame, schema: T.StructType) -> list[str]:
    """Key columns of ``schema`` that ``df`` does not have."""
    return [n for n in schema.names if n in KEY_COLUMNS and n not in df.columns]


def by_header(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Project text columns to ``schema`` by name."""
    missing = missing_keys(raw, schema)
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(raw.columns)}")
    absent = {n: F.lit(None).cast("string") for n in schema.names if n not in raw.columns}
    return cast_to(raw.withColumns(absent) if absent else raw, schema)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated table under a fixed schema."""
    return scan_typed(spark, path, schema, sep=",")


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def discover_tables(
    spark: SparkSession,
    root: str,
    *,
    pattern: str = "*.asc",
    sep: str = ";",
    by_folder: bool = False,
) -> dict[str, DataFrame]:
    """Every file under ``root`` matching ``pattern``, named by its stem.

    With ``by_folder`` a table is a folder of part files and has the folder's name. Only
    the distinct table paths reach the driver. Known tables get their fixed schema; any
    other, and one whose header lacks a key column, is read as text.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    path = F.col("path")
    if by_folder:
        listing = listing.option("recursiveFileLookup", True)
        path = F.regexp_replace(path, "/[^/]*$", "")
    paths = listing.load(root).select(path.alias("path")).distinct().toLocalIterator()
    found = {}
    for path in sorted(row.path for row in paths):
        stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        raw = scan_text(spark, path, sep=sep)
        known = stem in TABLES and not missing_keys(raw, TABLES[stem])
        found[stem] = by_header(raw, TABLES[stem]) if known else raw
    return found


def bank_tables(
    spark: SparkSession,
    root: str,
    *,
    suffix: str = ".asc",
    sep: str = ";",
    layouts: Mapping[str, T.StructType] = TABLES,
    keep_empty: bool = False,
) -> dict[str, DataFrame]:
    """The eight raw text tables under ``root``, cleaned as the plans expect them.

    Transactions and loans get their yymmdd date as a date and, in ``date_int``, as a number;
    opening and issue dates become dates. The district sentinel is left to the plans.
    """
    out = {
        n: scan_typed(spark, f"{root}/{n}{suffix}", layouts[n], sep=sep, keep_empty=keep_empty) for n in BANK_TABLES
    }
    for name in ("trans", "loan"):
        number = to_number(F.col("date")).cast("int")
        out[name] = out[name].withColumns({"date_int": number, "date": parse_yymmdd(F.col("date"))})
    out["account"] = out["account"].withColumn("date", parse_yymmdd(F.col("date")))
    issued = F.coalesce(parse_yymmdd_ts(F.col("issued")).cast("date"), parse_yymmdd(F.col("issued")))
    out["card"] = out["card"].withColumn("issued", issued)
    return out


def register_tables(tables: dict[str, DataFrame]) -> None:
    """Expose named frames to Spark SQL; ``order`` needs back quotes there."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows by an explicit order (a plain limit has no defined order)."""
    return df.orderBy(*order).limit(n)


def write_csv(df: DataFrame, path: str, *, sep: str = ",", compression: str = "none") -> None:
    """CSV with header, replacing what is there; white space around a text is part of it.

    With ``compression`` (such as gzip) a file is read again by one task; there is one for each task
    that writes.
    """
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep).option("compression", compression)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def convert_tables(
    spark: SparkSession, sources: dict[str, str], target_root: str, *, fmt: str = "csv"
) -> DataFrame:
    """Convert ``{table: path}`` from delimited text; one result row per table.

    A table that cannot be read is reported in ``error`` and the others go on.
    """
    summary = []
    for name, path in sources.items():
        target = f"{target_root}/{name}"
        try:
            df = scan_text(spark, path)
            if fmt == "csv":
                write_csv(df, target)
                written = spark.read.option("header", True).csv(target)
            else:
                df.write.mode("overwrite").format(fmt).save(target)
                written = spark.read.format(fmt).load(target)
            summary.append((name, written.count(), len(df.columns), None))
        except Exception as err:  # one bad table, whatever is wrong with it, must not stop the others
            condition = err.getCondition() if isinstance(err, PySparkException) else None
            summary.append((name, None, None, condition or type(err).__name__))
    return spark.createDataFrame(
        summary, "table_name string, row_count long, column_count int, error string"
    )


def scoring_events(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The declared 14-column event source; one switch makes the same plan a stream.

    A quoted empty field is an empty text, one without quotes is null.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(SCORING_EVENT).option("header", True).options(**KEEP_EMPTY)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(path)


def with_optional(
    df: DataFrame, candidates: list[DataFrame | None], key: str, value: str, default: str
) -> DataFrame:
    """Attach ``value`` from the first source that exists, else the constant.

    A source may hold several rows per key; the smallest value is taken so the result
    does not depend on row order. Without any source the constant fills every row; with
    one, a key it does not know stays null.
    """
    source = next((c for c in candidates if c is not None), None)
    if source is None:
        return df.withColumn(value, F.lit(default))
    one_per_key = source.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one_per_key, key, "left")
