"""Line dedup: drop lines that many documents share, except in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import lower_ascii, stripped
from ledgerlens.sources.storage import scratch_path


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """``lower_ascii``; a line of single bytes takes the quick way."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(lower_ascii(line))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_hash``, ``n_lines``, ``n_dropped``, ``kept``.

    Lines are exploded to hashes of their normalised form (ASCII white space stripped, A-Z
    lower-cased); distinct documents are counted per hash; lines of at least ``min_chars`` code
    points in at least ``min_docs`` documents stay only in the document with the largest id;
    the others are put together again by position.

    Texts are split once. Lines too short to count are dropped before anything is done to them; of
    the others a hash, the document and the position are written, and both the counts and the
    positions to drop are read from there. A line of a third of all rows is counted by partial
    aggregates; its rows meet the written list of hot lines in a join whose two sides are plain
    exchanges, which adaptive execution splits. The text moves once, to meet the positions dropped
    from it.

    Null or empty text is one empty line. Rows without id count for no document and lose every
    hot line. Repeated rows, and several texts under one id, are each treated whole. An empty
    table gives an empty result. Other columns of the input are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    spark = docs.sparkSession
    key = _key(stripped(F.col("line")))
    long = (
        rows.select("doc_id", "text_hash", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
    )
    # 96 bits of hash stand for the line
    path = scratch_path(spark, "lines")
    long.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("a"), F.hash("key").alias("b")).write.parquet(path)
    found = spark.read.parquet(path)
    hot = (
        found.select("a", "b", "doc_id")
        .distinct()
        .groupBy("a", "b")
        .agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("a", "b", "keeper")
    )
    path = scratch_path(spark, "hot-lines")
    hot.write.parquet(path)
    hot = spark.read.parquet(path)
    dropped = (
        found.join(hot, ["a", "b"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
        .agg(F.collect_set("pos").alias("drop"))
    )
    joined = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    lines = _split(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return (
        joined.withColumn("lines", lines)
        .withColumn("kept", F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
        ))
        .select(
            "doc_id",
            "text_hash",
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
            "kept",
        )
    )


def without_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options
) -> DataFrame:
    """``docs`` with the text that ``dedup_lines`` keeps, all other columns as they were, and
    ``length_col``, if there is one, brought up to date. A text that loses no line stays as it is,
    null included."""
    kept = dedup_lines(docs, id_col, text_col, **options).where("n_dropped > 0").dropDuplicates(["doc_id", "text_hash"])
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept"))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash"))
    joined = docs.join(kept, same, "left")
    text = F.coalesce(F.col("__kept"), docs[text_col])
    new = {text_col: text}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("__kept").isNotNull(), F.length("__kept").cast(docs.schema[length_col].dataType)).otherwise(docs[length_col])
    return joined.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
