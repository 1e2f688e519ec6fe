"""Prefixes, medians and splits against brute force, on groups of very different sizes."""

import random
import statistics

import pytest
from pyspark.sql import Window, functions as F

from ledgerlens.operators.profile_groups import profile_groups
from ledgerlens.operators.profiling import describe_numeric
from ledgerlens.operators.selection import fraction_of_group, hash_order, mark_prefix
from ledgerlens.operators.splits import chrono_split, sample_fraction, split_tables, train_test
from ledgerlens.sources import roles


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'a' holds half the rows, with a value that repeats; one key is null."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "a" if i % 2 else rng.choice(["b", "c", "d", None])
        value = 7.0 if rng.random() < 0.3 else round(rng.lognormvariate(3, 2), 2)
        rows.append((key, i, value if rng.random() < 0.95 else None, rng.choice(["x", "y", None])))
    return spark.createDataFrame(rows, "k string, id long, v double, c string")


@pytest.mark.parametrize("limit", [0, 200, 5000])
def test_medians_and_distincts_match_brute_force(skewed, limit):
    out = profile_groups(
        skewed, ["k"], [F.count("v").alias("n")], medians={"m": F.col("v")},
        distincts={"u": F.col("c"), "uv": F.col("v")}, limit=limit,
    )
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["k"], []).append(r)
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for key, rows in groups.items():
        values = [r["v"] for r in rows if r["v"] is not None]
        assert got[key]["n"] == len(values)
        assert got[key]["m"] == pytest.approx(statistics.median(values))
        assert got[key]["u"] == len({r["c"] for r in rows if r["c"]})
        assert got[key]["uv"] == len(set(values))


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.37, 0.5, 1.0])
@pytest.mark.parametrize("limit", [0, 400])
def test_prefix_equals_a_window(skewed, fraction, limit):
    out = mark_prefix(skewed, ["k"], F.col("v"), ["id"], wanted=fraction_of_group(fraction), limit=limit)
    group = Window.partitionBy("k")
    order = group.orderBy(F.col("v").asc_nulls_last(), hash_order(F.col("id")), "id")
    brute = skewed.withColumn("selected", F.row_number().over(order) <= F.floor(F.count("*").over(group) * fraction))
    assert sorted(out.select("id", "selected").collect()) == sorted(brute.select("id", "selected").collect())


def test_prefix_of_whole_frame(skewed):
    wanted = fraction_of_group(0.3)
    out = mark_prefix(skewed, [], -F.col("v"), ["id"], wanted=wanted)
    assert out.count() == 3000
    assert out.filter("selected").count() == 900
    low = out.filter("selected").agg(F.min("v")).first()[0]
    high = out.filter("not selected").agg(F.max("v")).first()[0]
    assert low >= high


def test_prefix_with_repeated_ids_is_still_exact(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.lit(1.0).alias("v"), (F.col("id") % 3).alias("id"))
    out = mark_prefix(df, ["k"], F.col("v"), ["id"], wanted=fraction_of_group(0.5), limit=100)
    assert out.filter("selected").count() == 500 and out.count() == 1000


def test_chrono_split_seven_equal_dates(spark):
    df = spark.range(7).selectExpr("1L as acc", "date'1999-01-01' as d", "id as t")
    assert chrono_split(df, "acc", "d", "t").filter("present").count() == 3


def test_sample_is_exact_and_reproducible(spark):
    ids = spark.range(1001).withColumnRenamed("id", "k")
    a = sample_fraction(ids, ["k"], 0.3).filter("selected").collect()
    b = sample_fraction(ids.repartition(7), ["k"], 0.3).filter("selected").collect()
    assert len(a) == 300 and sorted(a) == sorted(b)
    c = sample_fraction(ids, ["k"], 0.3, seed=1).filter("selected").collect()
    assert sorted(a) != sorted(c)


def test_train_test_disjoint(spark):
    df = spark.range(200).selectExpr("id as k", "cast(id % 4 = 0 as int) as y")
    train, test = train_test(df, "k", "y", disjoint=True)
    assert test.count() == 60
    assert train.join(test, "k").count() == 0
    assert train.filter("y = 1").count() == 0


def test_quartiles_equal_the_builtin(skewed):
    got = {r.column_name: r for r in describe_numeric(skewed, ["v", "id"]).collect()}
    for c in ("v", "id"):
        want = skewed.agg(*[F.percentile(c, p) for p in (0.25, 0.5, 0.75)], F.count(c), F.min(c), F.max(c)).first()
        r = got[c]
        assert (r.q25, r.q50, r.q75, r.cnt, r.min, r.max) == pytest.approx(tuple(want))


def test_hash_order_is_exact_as_double(spark):
    row = spark.range(1).select(hash_order(F.lit("x")).alias("h")).first()
    import hashlib

    assert row["h"] == float(int(hashlib.md5(b"x").hexdigest()[:13], 16))


def test_split_tables_loses_nothing(spark, sf):
    tables = roles.bank(spark, sf).tables()
    halves = split_tables(tables)
    for name, df in tables.items():
        present, stream = halves[name]
        total = df.count()
        counted = present.count()
        expected = 2 * total if name == "district" else total
        assert counted + stream.count() == expected, name


def test_window_prefix_uses_documented_order(skewed):
    out = mark_prefix(skewed, ["k"], F.col("v"), ["id"], wanted=F.lit(5))
    order = Window.partitionBy("k").orderBy(
        F.col("v").asc_nulls_last(), hash_order(F.col("id")), "id"
    )
    brute = skewed.withColumn("selected", F.row_number().over(order) <= 5)
    assert sorted(out.select("id", "selected").collect()) == sorted(
        brute.select("id", "selected").collect()
    )
