"""The two profiles on small hand-made banks, and equality of the skew paths on real tables."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import labels as L
from ledgerlens.plans import batch_features as B
from ledgerlens.plans.lookalike import client_snapshot, target_list
from ledgerlens.plans.realtime_features import realtime_features
from ledgerlens.sources import roles
from ledgerlens.sources.roles import Bank

TRANS = (
    "trans_id long, account_id long, date date, date_int int, type string, operation string, "
    "amount double, balance double, k_symbol string, bank string"
)


def day(n):
    return dt.date(1997, 12, 31) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def bank(spark):
    """Client 1: accounts 10 and 11; client 2: an account without rows; client 3: nothing."""
    t = [
        (1, 10, day(0), 971231, "PRIJEM", "o", 100.0, 10.0, "A", "b1"),
        (2, 10, day(1), 980101, "PRIJEM", "o", 300.0, 20.0, " ", "b1"),
        (3, 10, day(1), 980101, "VYDAJ", "p", 50.0, -5.0, None, "b2"),
        (4, 11, day(0), 971231, "PRIJEM", "o", 1000.0, 70.0, "A", None),
        (5, 11, day(0), 971231, "VYBER", "q", 7.0, None, "", "b1"),
    ]
    return Bank(
        client=spark.createDataFrame(
            [(1, "706213", 5), (2, "999", 6), (3, "450204", 9)],
            "client_id long, birth_number string, district_id long",
        ),
        account=spark.createDataFrame(
            [(10, 5, "M"), (11, 5, "W"), (12, 6, "M")],
            "account_id long, district_id long, frequency string",
        ).withColumn("date", F.lit(day(0))),
        disp=spark.createDataFrame(
            [(1, 1, 10, "OWNER"), (2, 1, 11, "OWNER"), (3, 2, 12, "DISPONENT")],
            "disp_id long, client_id long, account_id long, type string",
        ),
        trans=spark.createDataFrame(t, TRANS),
        loan=spark.createDataFrame(
            [(7, 10, day(0), 971231, 1000.0, 12, 90.0, "B")],
            "loan_id long, account_id long, date date, date_int int, amount double, duration int, "
            "payments double, status string",
        ),
        order=spark.createDataFrame(
            [(1, 10, "YZ", 5.0, " "), (2, 10, "ST", 15.0, "SIPO")],
            "order_id long, account_id long, bank_to string, amount double, k_symbol string",
        ),
        card=spark.createDataFrame(
            [(21, 1, "classic"), (22, 1, "Gold")], "card_id long, disp_id long, type string"
        ).withColumn("issued", F.lit(day(3))),
        district=spark.createDataFrame(
            [(5, "Praha", "Prague", 100, "?"), (6, "Brno", "Moravia", 200, "1.5")],
            "A1 long, A2 string, A3 string, A11 long, A12 string",
        ),
    )


def row_of(df, client):
    return df.filter(F.col("client_id") == client).first().asDict()


def test_batch_profile(bank):
    out = B.client_features(bank)
    assert {r["client_id"] for r in out.collect()} == {1}
    r = row_of(out, 1)
    assert r["num_accounts"] == 2 and r["total_transactions"] == 5
    assert r["avg_incoming"] == pytest.approx((200 + 1000) / 2)
    assert r["median_incoming"] == pytest.approx((200 + 1000) / 2)
    # One-row deviation is null and left out of the mean.
    assert r["std_incoming"] == pytest.approx(20000**0.5)
    assert r["transaction_span_days"] == 1
    assert r["transaction_frequency"] == pytest.approx((3 / 2 + 2 / 1) / 2)
    assert r["unique_k_symbols"] == 2 + 2
    assert (r["frequency"], r["loan_status_all"]) == ("M,W", "B")
    assert (r["num_classic_cards"], r["num_gold_cards"]) == (1, 0)
    assert r["loan_amount_total"] == 1000


def test_ids_profile_keeps_all_clients_and_does_not_fan_out(bank):
    out = B.client_features_with_ids(bank, card_stats=True)
    assert {r["client_id"] for r in out.collect()} == {1, 2, 3}
    r = row_of(out, 1)
    assert (r["card_id"], r["account_id"], r["trans_id"]) == ("21,22", "10,11", "1,4")
    assert r["total_transactions"] == 5 and r["loan_amount_total"] == 1000
    assert row_of(out, 2)["total_transactions"] == 0 and row_of(out, 3)["num_accounts"] is None
    usd = row_of(B.client_features_with_ids(bank, usd=True), 1)
    assert usd["loan_amount_total_usd"] == pytest.approx(38) and usd["loan_duration_avg"] == 12


def test_realtime_profile(bank):
    labels = L.loan_labels(bank.loan.withColumn("loan_purpose", F.lit("car")), bank.disp,
                           [bank.loan.select("account_id", F.lit("car").alias("loan_purpose"))])
    out = realtime_features(bank, loan_labels=labels)
    assert len(out.columns) == 97 and out.count() == 3
    r = row_of(out, 1)
    k = 0.038
    assert r["avg_incoming"] == pytest.approx(1400 / 3 * k)
    assert r["median_incoming"] == pytest.approx(300 * k)
    assert r["std_outgoing"] == 0 and r["unique_banks"] == 2 and r["unique_k_symbols"] == 2
    # 971231 and 980101 differ by 8870 as integers.
    assert r["transaction_span_days"] == 8870
    assert r["transaction_frequency"] == pytest.approx(5 / 8870)
    assert (r["account_id"], r["trans_id"], r["frequency"]) == ("10", "1", "M")
    assert (r["car_loan"], r["loan_purpose"], r["loan_status_all"]) == (1, "car", "B")
    assert r["unique_k_symbols_orders"] == 2
    assert (r["num_gold_cards"], r["gold_card"], r["junior_card"]) == (1, 1, 0)
    assert (r["A2"], r["A11"], r["A12"], r["A4"]) == ("Praha", 100.0, 0.0, 0.0)
    empty = row_of(out, 2)
    assert empty["num_accounts"] == 1 and empty["account_id"] == "" and empty["total_incoming"] == 0
    nothing = row_of(out, 3)
    assert (nothing["num_accounts"], nothing["frequency"], nothing["A2"]) == (0, "", "0")
    assert nothing["loan_purpose"] == ""


def test_v1_and_single_client(bank):
    full = row_of(B.client_features_v1(bank), 1)
    one = B.client_360(bank, 1).first().asDict()
    for c in ("num_accounts", "total_incoming_sum", "loan_amount_total", "num_orders", "num_cards"):
        assert full[c] == one[c], c
    none = B.client_360(bank, 3).first().asDict()
    assert none["num_accounts"] == 0 and none["total_incoming_sum"] == 0


def test_one_transaction_account(spark, bank):
    one = bank.trans.filter("trans_id = 4")
    r = A.trans_enhanced(one).first()
    assert r["std_incoming"] is None and r["balance_std"] is None and r["median_outgoing"] is None
    assert r["total_outgoing"] == 0 and r["transaction_span_days"] == 0


def test_last_balance_skips_nulls(bank):
    got = {r["account_id"]: r["last_balance"] for r in A.trans_agg_last(bank.trans).collect()}
    assert got == {10: -5.0, 11: 70.0}


def test_card_labels_keep_null_keys(spark, bank):
    lost = bank.card.unionByName(
        spark.createDataFrame([(23, 99, "junior")], "card_id long, disp_id long, type string").withColumn(
            "issued", F.lit(day(3))
        )
    )
    rows = {r["disp_id"]: r for r in L.card_labels(lost, bank.disp).collect()}
    assert rows[99]["client_id"] is None and rows[99]["junior"] == 1
    assert (rows[1]["classic"], rows[1]["gold"]) == (1, 0)
    assert {r["gold"] for r in L.card_labels(lost, bank.disp, ignore_case=True).collect()} == {0, 1}


def test_snapshot_takes_best_balance_nulls_last(bank):
    rows = {r["client_id"]: r for r in client_snapshot(bank).collect()}
    assert rows[1]["account_id"] == 11 and rows[2]["balance_last"] is None


def test_lookalikes_of_a_small_or_empty_cohort(spark, sf):
    bank = roles.bank(spark, sf)
    owners = bank.disp.where("type = 'OWNER'").join(bank.loan, "account_id", "left_semi")
    few = bank.loan.join(owners.orderBy("client_id").limit(6).select("account_id"), "account_id", "left_semi")
    asof = F.lit("1999-01-01").cast("date")
    some = target_list(replace(bank, loan=few), asof).agg(F.count("*"), F.count("similarity_score")).first()
    assert some[0] == some[1] > 0
    assert target_list(replace(bank, loan=bank.loan.where("false")), asof).isEmpty()
