"""Account-level and client-level summaries of transactions, loans, orders and cards.

The batch summaries keep absence as null and use the sample deviation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.cleaning import ratio_plus_one
from ledgerlens.operators.profile_groups import profile_groups

INCOMING, OUTGOING = "PRIJEM", "VYDAJ"


def amount_of(kind: str, amount: str = "amount") -> Column:
    """The amount of rows of one transaction type, null on other rows."""
    return F.when(F.col("type") == kind, F.col(amount))


def sum_or_zero(col: Column) -> Column:
    """Sum where the sum of nothing is 0."""
    return F.coalesce(F.sum(col), F.lit(0))


def distinct_text(col: Column, sep: str = ",") -> Column:
    """Aggregate: distinct non-null values in sorted order, joined."""
    return F.array_join(F.array_sort(F.collect_set(col.cast("string"))), sep)


def _flow_aggs() -> list[Column]:
    inn, out = amount_of(INCOMING), amount_of(OUTGOING)
    return [
        F.count("trans_id").alias("total_transactions"),
        F.count_if(F.col("type") == INCOMING).alias("num_incoming"),
        F.count_if(F.col("type") == OUTGOING).alias("num_outgoing"),
        sum_or_zero(inn).alias("total_incoming"),
        sum_or_zero(out).alias("total_outgoing"),
        F.avg(inn).alias("avg_incoming"),
        F.avg(out).alias("avg_outgoing"),
        F.min("balance").alias("balance_min"),
        F.max("balance").alias("balance_max"),
        F.avg("balance").alias("balance_mean"),
        F.date_diff(F.max("date"), F.min("date")).alias("transaction_span_days"),
    ]


def trans_basic(trans: DataFrame, *, key: str = "account_id") -> DataFrame:
    """Twelve transaction measures per account."""
    return profile_groups(
        trans, [key], _flow_aggs(), distincts={"unique_k_symbols": F.col("k_symbol")}
    )


def trans_enhanced(trans: DataFrame, *, key: str = "account_id") -> DataFrame:
    """Twenty-six transaction measures per account."""
    inn, out = amount_of(INCOMING), amount_of(OUTGOING)
    aggs = _flow_aggs() + [
        F.stddev_samp(inn).alias("std_incoming"),
        F.stddev_samp(out).alias("std_outgoing"),
        F.max(inn).alias("max_incoming"),
        F.max(out).alias("max_outgoing"),
        F.min(inn).alias("min_incoming"),
        F.min(out).alias("min_outgoing"),
        F.stddev_samp("balance").alias("balance_std"),
        F.min("date").alias("first_transaction_date"),
        F.max("date").alias("last_transaction_date"),
    ]
    return profile_groups(
        trans,
        [key],
        aggs,
        medians={"median_incoming": inn, "median_outgoing": out, "balance_median": F.col("balance")},
        distincts={
            "unique_k_symbols": F.col("k_symbol"),
            "unique_operations": F.col("operation"),
            "unique_banks": F.col("bank"),
        },
    )


def trans_derived(summary: DataFrame) -> DataFrame:
    """Nine ratios of the batch profile, divisors shifted by one."""
    c = F.col
    return summary.withColumns(
        {
            "net_cashflow": c("total_incoming") - c("total_outgoing"),
            "incoming_outgoing_ratio": ratio_plus_one(c("total_incoming"), c("total_outgoing")),
            "avg_transaction_amount": F.try_divide(
                c("total_incoming") + c("total_outgoing"), c("total_transactions")
            ),
            "transaction_frequency": ratio_plus_one(
                c("total_transactions"), c("transaction_span_days")
            ),
            "balance_volatility": ratio_plus_one(c("balance_std"), c("balance_mean")),
            "incoming_volatility": ratio_plus_one(c("std_incoming"), c("avg_incoming")),
            "outgoing_volatility": ratio_plus_one(c("std_outgoing"), c("avg_outgoing")),
            "max_to_avg_incoming_ratio": ratio_plus_one(c("max_incoming"), c("avg_incoming")),
            "max_to_avg_outgoing_ratio": ratio_plus_one(c("max_outgoing"), c("avg_outgoing")),
        }
    )


def _spread(column: str, name: str, suffix: str = "") -> list[Column]:
    return [
        F.avg(column).alias(f"{name}_avg{suffix}"),
        F.max(column).alias(f"{name}_max{suffix}"),
        F.min(column).alias(f"{name}_min{suffix}"),
    ]


def loan_summary(loan: DataFrame, *, key: str = "account_id", suffix: str = "") -> DataFrame:
    """Fourteen loan measures per account; ``suffix`` marks money columns."""
    return loan.groupBy(key).agg(
        F.count("loan_id").alias("num_loans"),
        sum_or_zero(F.col("amount")).alias(f"loan_amount_total{suffix}"),
        *_spread("amount", "loan_amount", suffix),
        *_spread("duration", "loan_duration"),
        *_spread("payments", "loan_payment", suffix),
        distinct_text(F.col("status")).alias("loan_status_all"),
        F.min("date").alias("first_loan_date"),
        F.max("date").alias("last_loan_date"),
    )


def loan_summary_short(loan: DataFrame, *, key: str = "account_id") -> DataFrame:
    return loan.groupBy(key).agg(
        sum_or_zero(F.col("amount")).alias("loan_amount_total"),
        F.avg("duration").alias("loan_avg_duration"),
        F.avg("payments").alias("loan_avg_payment"),
        distinct_text(F.col("status")).alias("loan_status"),
    )


def order_summary(order: DataFrame, *, key: str = "account_id", suffix: str = "") -> DataFrame:
    """Eight order measures per account; a blank category counts as a value."""
    aggs = [
        F.count("order_id").alias("num_orders"),
        F.avg("amount").alias(f"avg_order_amount{suffix}"),
        sum_or_zero(F.col("amount")).alias(f"total_order_amount{suffix}"),
        F.max("amount").alias(f"max_order_amount{suffix}"),
        F.min("amount").alias(f"min_order_amount{suffix}"),
        F.stddev_samp("amount").alias(f"std_order_amount{suffix}"),
    ]
    distincts = {
        "unique_banks_orders": F.col("bank_to"),
        "unique_k_symbols_orders": F.col("k_symbol"),
    }
    return profile_groups(order, [key], aggs, distincts=distincts)


def order_summary_short(order: DataFrame, *, key: str = "account_id") -> DataFrame:
    return order.groupBy(key).agg(
        F.count("amount").alias("num_orders"),
        F.avg("amount").alias("avg_order_amount"),
        sum_or_zero(F.col("amount")).alias("total_order_amount"),
    )


def cards_of_clients(card: DataFrame, disp: DataFrame) -> DataFrame:
    """Cards with the client and account of their disposition; unknown ones keep nulls."""
    bridge = disp.select("disp_id", "client_id", "account_id")
    return card.join(bridge, "disp_id", "left")


def card_summary(card: DataFrame, disp: DataFrame) -> DataFrame:
    """Six card measures per client; types are matched exactly."""
    kind = F.col("type")
    return cards_of_clients(card, disp).groupBy("client_id").agg(
        F.count("card_id").alias("num_cards"),
        F.min("issued").alias("earliest_card_issue"),
        F.max("issued").alias("latest_card_issue"),
        F.count_if(kind == "classic").alias("num_classic_cards"),
        F.count_if(kind == "junior").alias("num_junior_cards"),
        F.count_if(kind == "gold").alias("num_gold_cards"),
    )


def card_summary_short(card: DataFrame, disp: DataFrame) -> DataFrame:
    return cards_of_clients(card, disp).groupBy("client_id").agg(
        F.count("card_id").alias("num_cards"), F.min("issued").alias("earliest_card_issue")
    )


# Second level of the batch profile: how each account measure rolls up to the client.
# Names carry the suffix {s} where the value is money.
ROLLUP: Mapping[str, Sequence[str]] = {
    "sum": (
        "total_transactions", "num_incoming", "num_outgoing", "total_incoming", "total_outgoing",
        "unique_k_symbols", "unique_operations", "unique_banks", "net_cashflow", "num_loans",
        "loan_amount_total{s}", "num_orders", "total_order_amount{s}", "unique_banks_orders",
        "unique_k_symbols_orders",
    ),
    "avg": (
        "avg_incoming", "avg_outgoing", "median_incoming", "median_outgoing", "std_incoming",
        "std_outgoing", "balance_mean", "balance_median", "balance_std",
        "incoming_outgoing_ratio", "avg_transaction_amount", "transaction_frequency",
        "balance_volatility", "incoming_volatility", "outgoing_volatility",
        "max_to_avg_incoming_ratio", "max_to_avg_outgoing_ratio", "loan_amount_avg{s}",
        "loan_duration_avg", "loan_payment_avg{s}", "avg_order_amount{s}", "std_order_amount{s}",
    ),
    "max": (
        "max_incoming", "max_outgoing", "balance_max", "transaction_span_days",
        "loan_amount_max{s}", "loan_duration_max", "loan_payment_max{s}", "max_order_amount{s}",
    ),
    "min": (
        "min_incoming", "min_outgoing", "balance_min", "loan_amount_min{s}",
        "loan_duration_min", "loan_payment_min{s}", "min_order_amount{s}",
    ),
}


def rollup_columns(suffix: str = "") -> dict[str, str]:
    """{measure: function} of the client roll-up."""
    return {c.format(s=suffix): fn for fn, cols in ROLLUP.items() for c in cols}


def rollup_aggs(suffix: str = "") -> list[Column]:
    apply = {"sum": lambda c: sum_or_zero(F.col(c)), "avg": F.avg, "max": F.max, "min": F.min}
    return [apply[fn](c).alias(c) for c, fn in rollup_columns(suffix).items()]


def rollup_text_aggs() -> list[Column]:
    """Text and date measures of the client roll-up."""
    return [
        distinct_text(F.col("loan_status_all")).alias("loan_status_all"),
        distinct_text(F.col("frequency")).alias("frequency"),
        F.min("first_transaction_date").alias("first_transaction_date"),
        F.max("last_transaction_date").alias("last_transaction_date"),
        F.min("first_loan_date").alias("first_loan_date"),
        F.max("last_loan_date").alias("last_loan_date"),
    ]


def last_balance(*, order: Sequence[str] = ("date", "trans_id")) -> Column:
    """Aggregate: the latest balance that is known."""
    known = F.when(F.col("balance").isNotNull(), F.struct(*order))
    return F.max_by("balance", known)


def trans_agg_last(trans: DataFrame, *, key: str = "account_id") -> DataFrame:
    """Totals per account for scoring, with the last known balance."""
    return trans.groupBy(key).agg(
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.count("amount").alias("txn_count"),
        last_balance().alias("last_balance"),
    )


def trans_agg_model(
    trans: DataFrame, *, key: str = "account_id", with_last: bool = True
) -> DataFrame:
    """Totals per account for modelling."""
    aggs = [
        F.avg("amount").alias("amount_mean"),
        F.sum("amount").alias("amount_sum"),
        F.count("amount").alias("amount_count"),
        F.avg("balance").alias("balance_mean"),
        F.max("balance").alias("balance_max"),
        F.min("balance").alias("balance_min"),
    ]
    if with_last:
        aggs.append(last_balance().alias("balance_last"))
    return trans.groupBy(key).agg(*aggs)


def owner_accounts(disp: DataFrame) -> DataFrame:
    """Client and account pairs of owners, without duplicates."""
    return disp.filter(F.col("type") == "OWNER").select("client_id", "account_id").distinct()


def client_accounts(disp: DataFrame) -> DataFrame:
    """Sorted list of owner accounts per client. ``owner_accounts`` is the long form."""
    return owner_accounts(disp).groupBy("client_id").agg(
        F.array_sort(F.collect_list("account_id")).alias("account_ids")
    )


def id_pairs(client_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of the id lists: one distinct (client_id, id_kind, id) per row.

    Its size is spread over (client, id), so a client with very many ids does no harm.
    """
    kinds = [
        F.struct(F.lit(c).alias("id_kind"), F.col(c).cast("string").alias("id")) for c in columns
    ]
    return (
        client_rows.select("client_id", F.explode(F.array(*kinds)).alias("pair"))
        .select("client_id", "pair.id_kind", "pair.id")
        .filter(F.col("id").isNotNull())
        .distinct()
    )
