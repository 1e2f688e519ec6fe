"""What one task holds is bounded by rows, whatever the number of shuffle partitions."""

from statistics import median

import pytest
from pyspark.sql import Window, functions as F

from ledgerlens.operators import models as M
from ledgerlens.operators import skew
from ledgerlens.operators import splits as X
from ledgerlens.operators import summaries as S
from ledgerlens.operators.skew import split_hot
from ledgerlens.sources.storage import cut_lineage


def test_ordinary_groups_are_dealt_over_as_many_tasks_as_they_need(spark, monkeypatch):
    df = spark.range(2_000).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 150).alias("k"), "id")
    for rows, parts in ((100_000, 4), (100, 20), (50, 30)):
        monkeypatch.setattr(skew, "TASK_ROWS", rows)
        # the group of 500 and more rows is hot for the last one
        cold, hot = split_hot(df, ["k"], limit=1_000 if parts < 30 else 400)
        assert (hot is None) == (parts < 30)
        ranked = cold.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id")))
        assert ranked.groupBy("k").agg(F.max("r").alias("m"), F.count("*").alias("n")).where("m != n").count() == 0
        assert cold.count() + (hot.count() if hot is not None else 0) == 2_000
        if parts > 4:
            held = ranked.groupBy(F.spark_partition_id()).count().collect()
            assert parts * 0.7 < len(held) <= parts


def test_split_marks_facts_of_all_accounts_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 5)
    client = spark.range(20).withColumnRenamed("id", "client_id")
    disp = client.select(
        F.col("client_id").alias("disp_id"), "client_id", F.col("client_id").alias("account_id"), F.lit("OWNER").alias("type")
    )
    rows = [(a * 10 + i, a if a < 25 else None, f"2000-01-{i + 1:02d}") for a in range(26) for i in range(a % 4 + 1)]
    trans = spark.createDataFrame(rows, "trans_id long, account_id long, date string").withColumn("date", F.to_date("date"))
    halves = X.split_tables({"client": client, "disp": disp, "trans": trans})
    known = {r["account_id"] for r in disp.join(halves["client"][0], "client_id").collect()}
    assert len(known) == 17
    want = {t for t, a, _ in rows if a in known and t % 10 < (a % 4 + 1) // 2}
    present, stream = ([r["trans_id"] for r in half.collect()] for half in halves["trans"])
    assert set(present) == want and sorted(present + stream) == sorted(t for t, _, _ in rows)


def test_training_rows_come_in_bounded_portions(spark):
    df = cut_lineage(spark.range(0, 1_000, numPartitions=2))
    assert M.in_portions(df, 500) is df
    held = M.in_portions(df, 100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(held) == 10 and max(r["n"] for r in held) <= 130


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_medians_of_parts_that_were_not_merged(spark, limit):
    """The same value in several rows, and sizes taken from the sums."""
    trans = spark.createDataFrame(
        [(a, f"{a}-{i}", "PRIJEM", None, None, None, 970101, float(i % (a + 2)), float(i // 2)) for a in range(4) for i in range(9)],
        "account_id long, trans_id string, type string, operation string, k_symbol string, bank string, "
        "date_int int, amount double, balance double",
    )
    halves = [trans.where(F.pmod(F.hash("trans_id"), F.lit(3)) == i) for i in range(3)]
    values, sums = ([make(t) for t in halves] for make in (S.account_values, S.account_sums))
    values, sums = (p[0].unionByName(p[1]).unionByName(p[2]) for p in (values, sums))
    sizes = S.value_counts(S.merge_sums(sums, ["account_id"]), ["account_id"])
    assert {(r["account_id"], r["measure"]): r["_n"] for r in sizes.collect()}[1, "balance"] == 9
    got = S.weighted_medians(values, ["account_id"], {"in": "i", "balance": "b"}, limit=limit, sizes=sizes)
    want = {a: (median(i % (a + 2) for i in range(9)), median(i // 2 for i in range(9))) for a in range(4)}
    assert {r["account_id"]: (r["i"], r["b"]) for r in got.collect()} == want


def test_few_values_that_come_very_often_are_not_unfolded(spark):
    rows = [(1, "in", 5.0, None, 10**12), (1, "in", 5.0, None, 10**12), (1, "in", 7.0, None, 1)]
    values = spark.createDataFrame(rows, "account_id long, measure string, value double, text string, n long")
    sizes = spark.createDataFrame([(1, "in", 2 * 10**12 + 1)], "account_id long, measure string, _n long")
    got = S.weighted_medians(values, ["account_id"], {"in": "i"}, limit=2, sizes=sizes).collect()
    assert [(r["account_id"], r["i"]) for r in got] == [(1, 5.0)]
