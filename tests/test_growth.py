"""Steps that every row takes are taken once, and where there are fewest rows."""

from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from ledgerlens.functions import cleaning as C
from ledgerlens.operators.profile_groups import profile_groups
from ledgerlens.plans import targeting as G


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_age_is_worked_out_per_client(spark):
    rows = spark.createDataFrame(
        [(i, c, 1, "", "", 7.0, 3.0, 0) for i, c in enumerate([1, 1, 2, 0, 9])],
        "trans_id long, client_id long, account_id long, frequency string, birth_number string, amount double, "
        "balance double, district_id long",
    )
    client = spark.createDataFrame([(1, "700101", 5), (2, "bad", 5)], "client_id long, birth_number string, district_id long")
    account = spark.createDataFrame([(1, "m", date(1993, 1, 1))], "account_id long, frequency string, date date")
    district = spark.createDataFrame([(5, 8000)], "A1 long, A11 long")
    totals = spark.createDataFrame([(1, 9.0, 3.0, 3, 4.0)], "account_id long, total_amount double, avg_amount double, txn_count long, last_balance double")
    out = G.enrich_txn(rows, client, account, district, totals, asof=F.lit("1999-12-31").cast("date"))
    got = {r["trans_id"]: r["age"] for r in out.collect()}
    assert got == {0: 30, 1: 30, 2: None, 3: None, 4: None}
    made = [line for line in plan(out).splitlines() if "make_timestamp" in line]
    assert len(made) == 1 and "trans_id" not in made[0]


def test_yymmdd_dates_are_read_without_a_formatter(spark):
    cases = {"990101": date(1999, 1, 1), " 681231 ": date(2068, 12, 31), "690101": date(1969, 1, 1), "000229": date(2000, 2, 29),
             "990229": None, "991301": None, "990100": None, "99010": None, "9901011": None, "990101\n": None, "99010x": None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("d", C.parse_yymmdd(F.col("t")))
    assert {r["t"]: r["d"] for r in df.collect()} == cases
    assert "yyyyMMdd" not in plan(df)


@pytest.mark.parametrize("limit", [1_000, 5])
def test_medians_take_one_sort_for_each_group(spark, limit):
    rows = [(k, float((i * 7) % 5) if i % 3 else None, f"x{i % 2}" if i % 4 else None) for k in (None, 1, 2, 3) for i in range(k or 6)]
    df = spark.createDataFrame(rows, "k int, v double, t string")
    got = profile_groups(
        df, ["k"], [F.count(F.lit(1)).alias("n")], medians={"mid": F.col("v"), "up": F.col("v") + 1},
        distincts={"kinds": F.col("t")}, limit=limit,
    )
    for r in got.collect():
        mine = [(v, t) for k, v, t in rows if k == r["k"]]
        known = [v for v, _ in mine if v is not None]
        want = median(known) if known else None
        assert (r["n"], r["mid"], r["up"]) == (len(mine), want, None if want is None else want + 1)
        assert r["kinds"] == len({t for _, t in mine} - {None})
    assert got.count() == 4
    if limit > 5:
        assert "Window" not in plan(got)


def test_running_scores_derive_their_rows_once(spark, sf, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    rows = Q._scoring_rows(spark, sf)
    counted = rows.withColumn("trans_id", F.udf(count, "string").asNondeterministic()("trans_id"))
    monkeypatch.setattr(Q, "_scoring_rows", lambda *_: counted)
    Q.stream_score_running(spark, sf)
    assert seen.value == rows.count()
