"""Edges of cleaning, labels, rules and text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import cleaning as C
from ledgerlens.functions import rules as R
from ledgerlens.functions import vectors as V
from ledgerlens.operators import labels as L


def values(df, column, key="k"):
    return {r[key]: r[column] for r in df.collect()}


def test_yymmdd(spark):
    rows = ["930101", "690101", "680101", "000229", "010229", "93011", "x", None, " 930101 "]
    df = spark.createDataFrame([(r,) for r in rows], "k string")
    got = values(df.withColumn("d", C.parse_yymmdd(F.col("k"))), "d")
    assert got["930101"] == got[" 930101 "] == dt.date(1993, 1, 1)
    assert got["690101"] == dt.date(1969, 1, 1) and got["680101"] == dt.date(2068, 1, 1)
    assert got["000229"] == dt.date(2000, 2, 29)
    assert got["010229"] is got["93011"] is got["x"] is got[None] is None


def test_yymmdd_time(spark):
    df = spark.createDataFrame([("931107 00:00:00",), ("931107 23:59:58",), ("931107",)], "k string")
    got = values(df.withColumn("d", C.parse_yymmdd_ts(F.col("k"))), "d")
    assert got["931107 23:59:58"] == dt.datetime(1993, 11, 7, 23, 59, 58)
    assert got["931107"] is None


def test_birth_numbers(spark):
    asof = F.lit("1999-12-31").cast("date")
    rows = ["706213", "450204", "490101", "500101", "700231", "999", '"706213"', "7062130000"]
    df = spark.createDataFrame([(r,) for r in rows], "k string")
    df = df.withColumn("b", C.birth_date(F.col("k"))).withColumn("a", C.age_years(F.col("k"), asof))
    born, age = values(df, "b"), values(df, "a")
    assert born["706213"] == born['"706213"'] == born["7062130000"] == dt.date(1970, 12, 13)
    assert born["450204"] == dt.date(2045, 2, 4) and age["450204"] == -46
    assert born["490101"].year == 2049 and born["500101"].year == 1950
    assert born["700231"] is None and born["999"] is None
    assert age["706213"] == 29


def test_numbers_and_sentinels(spark):
    df = spark.createDataFrame([("1.5",), ("?",), ("",), (None,)], "k string")
    assert values(C.coerce_numeric(df.withColumn("n", F.col("k")), ["n", "gone"]), "n")["?"] is None
    filled = C.coerce_numeric(df.withColumn("n", F.col("k")), ["n"], fill=0)
    assert values(filled, "n") == {"1.5": 1.5, "?": 0.0, "": 0.0, None: 0.0}
    zero = df.withColumn("n", C.sentinel_to_zero(F.col("k")))
    assert values(zero, "n") == {"1.5": 1.5, "?": 0.0, "": 0.0, None: 0.0}


def test_usd_leaves_other_columns(spark):
    df = spark.createDataFrame([(1, 100.0, 12)], "k int, amount double, duration int")
    row = C.to_usd(df, ["amount", "payments"]).first()
    assert row["amount"] == pytest.approx(3.8) and row["duration"] == 12


def test_ratios(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, -1.0), (3, 10.0, 4.0)], "k int, a double, b double")
    a, b = F.col("a"), F.col("b")
    assert values(df.withColumn("r", C.ratio_plus_one(a, b)), "r") == {1: 10.0, 2: None, 3: 2.0}
    assert values(df.withColumn("r", C.ratio_guarded(a, b)), "r") == {1: 0.0, 2: 0.0, 3: 2.5}


def test_purposes(spark):
    df = spark.createDataFrame([("car",), ("house",), ("other",), ("unknown",), (None,)], "k string")
    out = L.with_purpose_flags(df, "k").withColumn("main", L.main_purpose())
    assert values(out, "main") == {"car": "car", "house": "home", "other": "personal", "unknown": "", None: ""}
    assert values(out, "personal_loan")[None] == 0


def scored(spark, **columns):
    base = {"age": 40, "balance": 60000.0, "income": 60000.0, "activity_score": 0.5,
            "has_employment": True, "has_default": False}
    row = base | columns
    return spark.createDataFrame(
        [tuple(row.values())],
        "age int, balance double, income double, activity_score double, has_employment boolean, "
        "has_default boolean",
    )


@pytest.mark.parametrize(
    "age,points", [(24, 0.0), (25, 0.1), (29, 0.1), (30, 0.2), (50, 0.2), (51, 0.1), (60, 0.1), (61, 0.0)]
)
def test_age_bands_and_rules(spark, age, points):
    df = scored(spark, age=age)
    row = df.select(R.rule_score().alias("s"), R.eligible(R.HOME_LOAN_RULES).alias("e")).first()
    assert row["s"] == pytest.approx(0.2 + 0.3 + 0.1 + points)
    assert row["e"] == (25 <= age <= 60)


@pytest.mark.parametrize(
    "balance,ok,points",
    [(0.0, False, 0), (None, False, 0), (-1.0, False, 0), (50000.0, True, 0.1), (100000.01, True, 0.3)],
)
def test_balance_bounds(spark, balance, ok, points):
    df = scored(spark, balance=balance, age=None, income=0.0, activity_score=0.0)
    rules = {"min_balance": 50000, "min_age": 0}
    row = df.select(R.eligible(rules).alias("e"), R.rule_score().alias("s")).first()
    assert row["e"] == ok and row["s"] == pytest.approx(points)


def test_switches_and_reasons(spark):
    df = scored(spark, has_employment=False, has_default=True, age=20)
    row = df.select(
        R.eligible({}).alias("off"),
        R.eligible({"employment_required": True}).alias("job"),
        R.eligible({"reject_previous_default": True}).alias("clean"),
        R.ineligible_reasons(R.HOME_LOAN_RULES).alias("why"),
        R.ineligible_reasons({"max_age": 10}).alias("other"),
    ).first()
    assert (row["off"], row["job"], row["clean"]) == (True, False, False)
    assert row["why"] == "age < 25" and row["other"] == "config rules"


def test_decision_text(spark):
    df = scored(spark, balance=123456.789, income=50000.0, activity_score=0.05).withColumn(
        "client_id", F.lit(7)
    )
    line = df.select(R.decision_line(R.HOME_LOAN_RULES)).first()[0]
    assert line == (
        "TARGET: Client 7 | Features: {'age': 40, 'balance': 123456.79, 'income': 50000.0, "
        "'activity_score': 0.05} | Predicted(accept): True (prob: 0.710)"
    )
    refused = df.withColumn("client_id", F.lit(0)).select(
        R.decision_line({"min_age": 50}, product="card")
    ).first()[0]
    assert refused == "SKIP:   Client N/A | Ineligible under card config (age < 50)"


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    got = values(V.with_unit(df, "v", 2, name="u"), "u")
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_suffix_columns_keeps_the_named_ones(spark):
    df = spark.range(1).selectExpr("id", "1 as a", "2 as b")
    assert C.suffix_columns(df, "_x", keep=["id"]).columns == ["id", "a_x", "b_x"]
