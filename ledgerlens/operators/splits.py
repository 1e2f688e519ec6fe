"""Reproducible samples, entity splits and chronological splits, exact at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.selection import fraction_of_group, hash_order, mark_prefix
from ledgerlens.sources.storage import cut_lineage


def sample_fraction(
    df: DataFrame,
    id_columns: Sequence[str],
    fraction: float,
    *,
    seed: int = 42,
    name: str = "selected",
) -> DataFrame:
    """Mark exactly floor(rows * fraction) rows, in the order of a seeded hash of the id."""
    order = hash_order(F.lit(seed), *[F.col(c) for c in id_columns])
    return mark_prefix(df, [], order, id_columns, wanted=fraction_of_group(fraction), name=name)


def entity_split(
    df: DataFrame,
    entity: str,
    *,
    fraction: float = 0.85,
    seed: int = 42,
) -> DataFrame:
    """Distinct entities with ``present``: in the first share of a seeded order or not."""
    ids = df.select(entity).distinct()
    return sample_fraction(ids, [entity], fraction, seed=seed, name="present")


def chrono_split(
    df: DataFrame,
    key: str,
    date: str,
    row_id: str,
    *,
    fraction: float = 0.5,
) -> DataFrame:
    """Mark the earliest floor(n * fraction) rows of each key as ``present``."""
    when = F.unix_micros(F.col(date).cast("timestamp"))
    return mark_prefix(
        df, [key], when, [row_id], wanted=fraction_of_group(fraction), name="present"
    )


def train_test(
    df: DataFrame,
    entity: str,
    target: str,
    *,
    test_size: float = 0.3,
    seed: int = 42,
    disjoint: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): a share of rows without the target, and a share of all rows.

    The two are drawn independently and may overlap; ``disjoint`` takes test rows out of
    the training set.
    """
    marked = sample_fraction(df, [entity], test_size, seed=seed, name="_test")
    test = marked.filter("_test").drop("_test")
    pool = df.filter(F.col(target) == 0)
    if disjoint:
        pool = pool.join(test.select(entity), entity, "left_anti")
    kept = sample_fraction(pool, [entity], 1 - test_size, seed=seed + 1, name="_train")
    return kept.filter("_train").drop("_train"), test


# Table -> (column, which id set routes it). A table that is not listed goes by client_id if
# it has one, else by account_id, else wholly to the present half.
ROUTES = {
    "client": ("client_id", "client"),
    "account": ("account_id", "account"),
    "disp": ("account_id", "account"),
    "loan": ("account_id", "account"),
    "order": ("account_id", "account"),
    "card": ("disp_id", "disp"),
    "trans": ("trans_id", "trans"),
    "loan_labels": ("client_id", "client"),
    "card_labels": ("client_id", "client"),
    "district": (None, "both"),
}


def split_tables(
    tables: dict[str, DataFrame],
    *,
    entity_fraction: float = 0.85,
    fact_fraction: float = 0.5,
    seed: int = 42,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each table as (present, stream).

    Owners' accounts follow their client. The facts of present accounts are cut by time;
    all other facts go to the stream half. The cut is marked on all accounts, so that facts move once.
    """
    split = entity_split(tables["client"], "client_id", fraction=entity_fraction, seed=seed)
    present_clients = split.filter("present").select("client_id")
    owners = tables["disp"].filter(F.col("type") == "OWNER").select("client_id", "account_id")
    present_accounts = (
        owners.join(present_clients, "client_id", "left_semi").select("account_id").distinct()
    )
    present_disps = (
        tables["disp"].join(present_accounts, "account_id", "left_semi").select("disp_id").distinct()
    )
    ids = {"client": present_clients, "account": present_accounts, "disp": present_disps}
    if "trans" in tables:
        facts = tables["trans"].columns
        cut = chrono_split(
            tables["trans"], "account_id", "date", "trans_id", fraction=fact_fraction
        )
        known = present_accounts.withColumn("_known", F.lit(True))
        cut = cut.join(known, "account_id", "left").select(
            *facts, (F.col("present") & F.col("_known").isNotNull()).alias("present")
        )
        # Marked once and written: both halves are read from it, and no row is looked up again.
        cut = cut_lineage(cut)
        halves = (
            cut.filter("present").select(*facts),
            cut.filter(~F.col("present")).select(*facts),
        )
    out = {}
    for name, df in tables.items():
        key, route = ROUTES.get(name, (None, None))
        if route is None:
            fallback = [(c, r) for c, r in (("client_id", "client"), ("account_id", "account"))
                        if c in df.columns]
            key, route = fallback[0] if fallback else (None, "present")
        if route == "both":
            out[name] = (df, df)
        elif route == "trans":
            out[name] = halves
        elif route == "present":
            out[name] = (df, df.limit(0))
        else:
            out[name] = (
                df.join(ids[route], key, "left_semi"),
                df.join(ids[route], key, "left_anti"),
            )
    return out
