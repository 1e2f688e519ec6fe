import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import number_rows, quantiles, rows_at


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    sizes = {1: 6000, 2: 1, 3: 2, 4: 7, None: 50, 5: 300}
    rows = [
        (k, int(i), float(v) if rng.random() > 0.1 else None)
        for k, n in sizes.items()
        for i, v in enumerate(rng.choice([0.0, 0.0, 0.0, 1.5, -2.0, 7.0, 9.25, 11.0], n))
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(
        [(None if k is None else int(k), int(i), v) for k, i, v in rows], "k long, i long, v double"
    ).repartition(7)


def test_ranks_of_groups_larger_than_a_partition(groups):
    out = number_rows(groups, ["k"], ["v", "i"]).toPandas()
    assert len(out) == groups.count()
    for _, g in out.groupby("k", dropna=False):
        g = g.sort_values(["v", "i"], na_position="first")
        assert list(g["rank"]) == list(range(1, len(g) + 1))
        assert set(g["size"]) == {len(g)}


def test_a_value_that_all_rows_share_is_spread(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(3.0).alias("v"))
    out = number_rows(df, ["k"], ["v"])
    assert out.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (20_000, 1, 20_000)


def test_one_group_without_keys(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v"))
    out = number_rows(df, [], ["v"])
    assert out.where("rank <> v + 1 or size <> 1000").isEmpty()


def test_rows_at_chosen_ranks(groups):
    out = rows_at(groups, ["k"], ["v", "i"], {"first": F.lit(1), "last": F.col("_size"), "far": F.lit(5000)})
    got = {(r.k, r.which): (r.v, r.i) for r in out.collect()}
    pdf = groups.toPandas()
    for k, g in pdf.groupby("k", dropna=False):
        k = None if pd.isna(k) else int(k)
        g = g.sort_values(["v", "i"], na_position="first").reset_index(drop=True)
        for which, at in (("first", 0), ("last", len(g) - 1), ("far", 4999)):
            if at >= len(g):
                assert (k, which) not in got
                continue
            v, i = got[k, which]
            assert i == g["i"][at] and (v == g["v"][at] or (v is None and pd.isna(g["v"][at])))


def test_quantiles_are_interpolated_over_known_values(groups):
    out = quantiles(groups, ["k"], {"v": F.col("v"), "i": F.col("i")}, {"q1": 0.25, "mid": 0.5, "top": 1.0})
    got = {(r.k, r.measure): (r.q1, r.mid, r.top) for r in out.collect()}
    for k, g in groups.toPandas().groupby("k", dropna=False):
        k = None if pd.isna(k) else int(k)
        for c in ("v", "i"):
            values = g[c].dropna()
            if len(values):
                np.testing.assert_allclose(got[k, c], np.quantile(values, [0.25, 0.5, 1.0]), rtol=0, atol=1e-12)
            else:
                assert (k, c) not in got


def test_an_empty_frame_has_no_ranks(spark):
    empty = spark.createDataFrame([], "k long, v double")
    assert number_rows(empty, ["k"], ["v"]).isEmpty()
    assert quantiles(empty, ["k"], {"v": F.col("v")}, {"m": 0.5}).isEmpty()
