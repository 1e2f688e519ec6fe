"""Client features of the batch profile: account summaries, then a client roll-up."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.cleaning import CZK_TO_USD, fill_numeric, to_usd
from ledgerlens.operators import aggregates as A
from ledgerlens.sources.roles import Bank

ID_COLUMNS = ("account_id", "card_id", "loan_id", "order_id", "trans_id")
V1_COLUMNS = (
    "client_id", "birth_number", "district_id", "A2", "A3", "A10", "A11", "num_accounts",
    "total_balance_mean", "total_incoming_sum", "total_outgoing_sum", "loan_amount_total",
    "loan_status_all", "num_orders", "num_cards", "earliest_card_issue",
)


def with_district(clients: DataFrame, district: DataFrame) -> DataFrame:
    """Left join on differently named keys."""
    return clients.join(district, clients["district_id"] == district["A1"], "left")


def account_summary(bank: Bank, *, suffix: str = "", only_active: bool = False) -> DataFrame:
    """One row per account: frequency and the transaction, loan and order measures.

    ``only_active`` keeps accounts with at least one transaction.
    """
    trans = A.trans_derived(A.trans_enhanced(bank.trans))
    return (
        bank.account.select("account_id", "frequency")
        .join(trans, "account_id", "inner" if only_active else "left")
        .join(A.loan_summary(bank.loan, suffix=suffix), "account_id", "left")
        .join(A.order_summary(bank.order, suffix=suffix), "account_id", "left")
    )


def _rollup(
    pairs: DataFrame, summary: DataFrame, suffix: str = "", extra=()
) -> DataFrame:
    """Account rows per client to one row per client.

    The distinct count of accounts runs apart on the two id columns: next to it, every
    other measure would have to pass through the distinct aggregation.
    """
    counts = pairs.select("client_id", "account_id").distinct().groupBy("client_id").agg(
        F.count("account_id").alias("num_accounts")
    )
    measures = pairs.join(summary, "account_id", "left").groupBy("client_id").agg(
        *A.rollup_aggs(suffix), *A.rollup_text_aggs(), *extra
    )
    return counts.join(measures, "client_id")


def client_features(bank: Bank, *, fill: bool = False) -> DataFrame:
    """Owners' accounts rolled up per client, card measures and district.

    Clients without an owned account drop out. ``fill`` turns null numbers into 0.
    """
    summary = account_summary(bank, only_active=True)
    owned = bank.disp.filter(F.col("type") == "OWNER").select("client_id", "account_id")
    features = _rollup(owned, summary)
    joined = (
        bank.client.join(features, "client_id", "inner")
        .join(A.card_summary(bank.card, bank.disp), "client_id", "left")
    )
    out = with_district(joined, bank.district)
    return fill_numeric(out) if fill else out


def _with_ids(bank: Bank) -> DataFrame:
    """Every disposition with its card ids and one sample id per fact table.

    Card ids are collected per (client, account) first, so that several cards on one
    disposition do not multiply the account measures. Sample ids are the smallest ones.
    """
    rows = bank.disp.select("client_id", "account_id")
    cards = A.cards_of_clients(bank.card, bank.disp)
    card_ids = cards.groupBy("client_id", "account_id").agg(
        F.collect_set(F.col("card_id").cast("string")).alias("_cards")
    )
    rows = rows.join(card_ids, ["client_id", "account_id"], "left")
    for name in ("trans", "loan", "order"):
        rows = rows.join(_sample_id(bank, name), "account_id", "left")
    return rows


def _sample_id(bank: Bank, name: str) -> DataFrame:
    table = getattr(bank, name)
    return table.groupBy("account_id").agg(F.min(f"{name}_id").alias(f"{name}_id"))


def client_features_with_ids(
    bank: Bank,
    *,
    card_stats: bool = False,
    usd: bool = False,
    rate: float = CZK_TO_USD,
) -> DataFrame:
    """All dispositions rolled up per client, with id lists; every client is kept.

    ``card_stats`` adds the card measures, ``usd`` converts money first and names loan and
    order money ``*_usd``.
    """
    if usd:
        bank = replace(
            bank,
            trans=to_usd(bank.trans, ["amount", "balance"], rate=rate),
            loan=to_usd(bank.loan, ["amount", "payments"], rate=rate),
            order=to_usd(bank.order, ["amount"], rate=rate),
        )
    suffix = "_usd" if usd else ""
    summary = account_summary(bank, suffix=suffix)
    lists = [
        A.distinct_text(F.col(c)).alias(c) for c in ("account_id", "loan_id", "order_id", "trans_id")
    ]
    cards = F.array_distinct(F.flatten(F.collect_list("_cards")))
    lists.append(F.array_join(F.array_sort(cards), ",").alias("card_id"))
    out = bank.client.join(_rollup(_with_ids(bank), summary, suffix, lists), "client_id", "left")
    if card_stats:
        out = out.join(A.card_summary(bank.card, bank.disp), "client_id", "left")
    return with_district(out, bank.district)


def client_id_rows(bank: Bank) -> DataFrame:
    """Long form of the id lists, for clients with very many ids."""
    rows = bank.disp.select("client_id", "account_id")
    for name in ("trans", "loan", "order"):
        rows = rows.join(_sample_id(bank, name), "account_id", "left")
    wide = A.id_pairs(rows, ("account_id", "loan_id", "order_id", "trans_id"))
    return wide.unionByName(A.id_pairs(A.cards_of_clients(bank.card, bank.disp), ("card_id",)))


def client_features_v1(bank: Bank) -> DataFrame:
    """The sixteen-column first version, without duplicate rows."""
    summary = (
        bank.account.select("account_id")
        .join(A.trans_basic(bank.trans), "account_id", "left")
        .join(A.loan_summary_short(bank.loan), "account_id", "left")
        .join(A.order_summary_short(bank.order), "account_id", "left")
    )
    owned = bank.disp.filter(F.col("type") == "OWNER").select("client_id", "account_id")
    features = owned.join(summary, "account_id", "left").groupBy("client_id").agg(
        F.count_distinct("account_id").alias("num_accounts"),
        F.avg("balance_mean").alias("total_balance_mean"),
        A.sum_or_zero(F.col("total_incoming")).alias("total_incoming_sum"),
        A.sum_or_zero(F.col("total_outgoing")).alias("total_outgoing_sum"),
        A.sum_or_zero(F.col("loan_amount_total")).alias("loan_amount_total"),
        A.distinct_text(F.col("loan_status")).alias("loan_status_all"),
        A.sum_or_zero(F.col("num_orders")).alias("num_orders"),
    )
    joined = (
        bank.client.join(features, "client_id", "left")
        .join(A.card_summary_short(bank.card, bank.disp), "client_id", "left")
    )
    final = with_district(joined, bank.district)
    return final.select(*[c for c in V1_COLUMNS if c in final.columns]).distinct()


def client_360(bank: Bank, client_id: int) -> DataFrame:
    """One client on one row. Every fact table is filtered to the client's accounts first."""
    me = F.col("client_id") == client_id
    owned = bank.disp.filter(me & (F.col("type") == "OWNER"))
    accounts = owned.select("account_id").distinct()

    def mine(df: DataFrame) -> DataFrame:
        return df.join(accounts, "account_id", "left_semi")

    loans, orders = mine(bank.loan), mine(bank.order)
    summary = (
        mine(bank.account)
        .select("account_id")
        .join(A.trans_basic(mine(bank.trans)), "account_id", "left")
        .join(A.loan_summary_short(loans), "account_id", "left")
        .join(A.order_summary_short(orders), "account_id", "left")
    )
    totals = summary.agg(
        F.count(F.lit(1)).alias("num_accounts"),
        F.avg("balance_mean").alias("total_balance_mean"),
        A.sum_or_zero(F.col("total_incoming")).alias("total_incoming_sum"),
        A.sum_or_zero(F.col("total_outgoing")).alias("total_outgoing_sum"),
        A.sum_or_zero(F.col("loan_amount_total")).alias("loan_amount_total"),
    ).withColumn("client_id", F.lit(client_id))
    num_cards = (
        bank.card.join(owned.select("disp_id").distinct(), "disp_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("num_cards"))
        .withColumn("client_id", F.lit(client_id))
    )
    num_orders = orders.agg(F.count(F.lit(1)).alias("num_orders")).withColumn(
        "client_id", F.lit(client_id)
    )
    profile = with_district(bank.client.filter(me), bank.district)
    shown = ["client_id", "birth_number", "district_id", "A2", "A3", "A10", "A11"]
    out = profile.select(*[c for c in shown if c in profile.columns])
    for piece in (totals, num_cards, num_orders):
        out = out.join(piece, "client_id", "left")
    return out
