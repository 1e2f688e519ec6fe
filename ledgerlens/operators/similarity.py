"""Look-alike ranking against a cohort, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.functions import vectors as V
from ledgerlens.functions.cleaning import flag
from ledgerlens.operators.selection import mark_prefix


def fit_scaler(frames: Sequence[DataFrame], column: str, width: int) -> DataFrame:
    """One row with ``mean`` and ``std`` (population) over the rows of all frames."""
    rows = frames[0].select(column)
    for other in frames[1:]:
        rows = rows.unionByName(other.select(column))
    return rows.agg(
        V.mean_vector(column, width).alias("mean"), V.std_vector(column, width).alias("std")
    )


def standardize(df: DataFrame, column: str, scaler: DataFrame, width: int) -> DataFrame:
    """Scale ``column`` in place; the one-row scaler enters as a scalar subquery."""
    fitted = scaler.select(F.struct("mean", "std")).scalar()
    return df.withColumn("_fit", fitted).withColumn(
        column, V.scaled(column, "_fit.mean", "_fit.std", width)
    ).drop("_fit")


def cohort_similarity(
    df: DataFrame, cohort: DataFrame, column: str, width: int, *, name: str = "similarity_score"
) -> DataFrame:
    """Mean cosine similarity of every row to the cohort.

    The mean over the cohort of cos(x, c) is the dot product of unit x with the mean unit
    vector of the cohort, so the cohort shrinks to one row and no pairs are formed.
    """
    sized = cohort.withColumn("_len", V.length(column, width))
    centroid = sized.agg(V.mean_vector(column, width, by="_len").alias("c")).scalar()
    return df.withColumn("_c", centroid).withColumn(
        name, V.dot(column, "_c", width) / V.length(column, width)
    ).drop("_c")


def rank_by_score(df: DataFrame, score: str, id_column: str) -> DataFrame:
    """Global order, best first: a range-partitioned sort."""
    return df.orderBy(F.desc(score), F.col(id_column))


def top_targets(
    df: DataFrame,
    score: str,
    id_column: str,
    *,
    share: float = 0.2,
    floor: int = 100,
) -> DataFrame:
    """The best max(floor, rows * share) rows."""
    wanted = F.greatest(F.lit(floor), F.floor(F.col("_size") * F.lit(share)))
    marked = mark_prefix(df, [], -F.col(score), [id_column], wanted=wanted, name="_top")
    return marked.filter("_top").drop("_top")


def _numbered(df: DataFrame, order, n: int) -> DataFrame:
    """The first n rows with their place; n is a small constant of the report."""
    head = df.orderBy(*order).limit(n)
    return head.withColumn("_place", F.row_number().over(Window.orderBy(*order)))


def precision_at_k(
    df: DataFrame,
    score: str,
    label: str,
    id_column: str,
    *,
    ks: Sequence[int] = (10, 20, 50, 100),
) -> DataFrame:
    """Share of positive labels among the k best; a k above the row count is left out."""
    order = [F.desc(score), F.col(id_column)]
    head = _numbered(df.select(score, label, id_column), order, max(ks))
    sized = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    placed = head.select("_place", F.col(label).alias("_y"), sized)
    return (
        placed.filter(F.col("_place") <= F.col("k"))
        .groupBy("k")
        .agg(F.sum("_y").cast("long").alias("hits"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == F.col("k"))
        .select("k", "hits", (F.col("hits") / F.col("k")).alias("precision"))
    )


def cohort_eval(
    df: DataFrame, score: str, label: str, id_column: str, *, n: int = 100
) -> DataFrame:
    """One row: label share of the n best and n worst, mean score by label, pass flags."""
    slim = df.select(score, label, id_column)

    def ends(order, prefix: str) -> DataFrame:
        return slim.orderBy(*order).limit(n).agg(
            F.count(F.lit(1)).alias(f"{prefix}_n"), F.sum(label).cast("long").alias(f"{prefix}_hits")
        )

    best = ends([F.desc(score), F.col(id_column)], "top")
    worst = ends([F.col(score), F.desc(id_column)], "bottom")
    with_label, without = F.col(label) == 1, F.col(label) == 0
    overall = slim.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(with_label).alias("users_with"),
        F.count_if(without).alias("users_without"),
        F.avg(F.when(with_label, F.col(score))).alias("mean_with"),
        F.avg(F.when(without, F.col(score))).alias("mean_without"),
    )
    one = overall.withColumns(
        {
            "_t": best.select(F.struct("top_n", "top_hits")).scalar(),
            "_b": worst.select(F.struct("bottom_n", "bottom_hits")).scalar(),
        }
    ).select("*", "_t.*", "_b.*").drop("_t", "_b")
    top_share = F.try_divide(F.col("top_hits") * 100.0, F.col("top_n"))
    bottom_share = F.try_divide(F.col("bottom_hits") * 100.0, F.col("bottom_n"))
    return one.withColumns(
        {
            "top_percent": top_share,
            "bottom_percent": bottom_share,
            "top_passes": flag(top_share > 50),
            "bottom_passes": flag(bottom_share < 50),
        }
    )


def class_means(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows and mean score per class."""
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score")
    )
