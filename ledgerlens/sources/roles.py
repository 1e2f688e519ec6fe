"""The bank tables as roles over the star-schema parquet tables of a directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.sources.tables import scan_table


@dataclass(frozen=True)
class Bank:
    """The eight tables every feature plan starts from."""

    client: DataFrame
    account: DataFrame
    disp: DataFrame
    trans: DataFrame
    loan: DataFrame
    order: DataFrame
    card: DataFrame
    district: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def _text(col: Column) -> Column:
    return col.cast("string")


def _pick(selector: Column, values: list[str | None]) -> Column:
    """Value by position of ``selector`` in ``values``; the last one is the default."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(selector == i, F.lit(v)).otherwise(out)
    return out


def yymmdd(date: Column) -> Column:
    """A date as the integer yymmdd."""
    return (F.year(date) % 100) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def _line_id() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return F.concat_ws("-", *[_text(F.col(p)) for p in parts], _text(cents))


def clients(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey")
    digits = [10 + k % 80, 1 + k % 12 + 50 * (k % 2), 1 + k % 28]
    regular = F.concat(*[F.lpad(_text(d), 2, "0") for d in digits])
    birth = F.when(k % 97 == 0, "999").when(k % 89 == 0, "700231").otherwise(regular)
    return scan_table(spark, root, "customer").select(
        k.alias("client_id"), F.col("c_nationkey").alias("district_id"), birth.alias("birth_number")
    )


def dispositions(spark: SparkSession, root: str) -> DataFrame:
    role = F.when(F.col("o_orderpriority") == "5-LOW", "DISPONENT").otherwise("OWNER")
    return scan_table(spark, root, "orders").select(
        F.col("o_orderkey").alias("disp_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderkey").alias("account_id"),
        role.alias("type"),
    )


def accounts(spark: SparkSession, root: str) -> DataFrame:
    customer = scan_table(spark, root, "customer").select("c_custkey", "c_nationkey")
    orders = scan_table(spark, root, "orders")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("account_id"),
        F.col("c_nationkey").alias("district_id"),
        F.col("o_orderpriority").alias("frequency"),
        F.to_date("o_orderdate").alias("date"),
    )


def transactions(spark: SparkSession, root: str) -> DataFrame:
    line = F.col("l_linenumber")
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "PRIJEM").when(flag == "R", "VYDAJ").otherwise("VYBER")
    symbol = F.when(line % 5 == 0, " ").when(
        line % 5 != 1, F.concat(F.lit("K"), _text(line % 5))
    )
    price = F.col("l_extendedprice")
    return scan_table(spark, root, "lineitem").select(
        _line_id().alias("trans_id"),
        F.col("l_orderkey").alias("account_id"),
        F.to_date("l_shipdate").alias("date"),
        yymmdd(F.col("l_shipdate")).alias("date_int"),
        kind.alias("type"),
        F.col("l_linestatus").alias("operation"),
        price.alias("amount"),
        (price * (1 - F.col("l_discount")) - 20000).alias("balance"),
        symbol.alias("k_symbol"),
        F.concat(F.lit("B"), _text(F.col("l_suppkey") % 13)).alias("bank"),
    )


PURPOSE_BY_NINE = [
    "car",
    "credit_card",
    "debt_consolidation",
    "home_improvement",
    "major_purchase",
    "medical",
    "small_business",
    "unknown",
    None,
]


def loans(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("o_orderkey")
    duration = (12 * (1 + k % 5)).cast("int")
    return (
        scan_table(spark, root, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(
            k.alias("loan_id"),
            k.alias("account_id"),
            F.to_date("o_orderdate").alias("date"),
            yymmdd(F.col("o_orderdate")).alias("date_int"),
            F.col("o_totalprice").alias("amount"),
            duration.alias("duration"),
            (F.col("o_totalprice") / duration).alias("payments"),
            _pick(k % 4, ["A", "B", "C", "D"]).alias("status"),
            _pick(k % 9, PURPOSE_BY_NINE).alias("loan_purpose"),
        )
    )


def orders(spark: SparkSession, root: str) -> DataFrame:
    return (
        transactions(spark, root)
        .filter((F.col("type") == "VYBER") & (F.col("operation") == "O"))
        .select(
            F.col("trans_id").alias("order_id"),
            "account_id",
            F.col("bank").alias("bank_to"),
            "amount",
            "k_symbol",
        )
    )


def cards(spark: SparkSession, root: str) -> DataFrame:
    return (
        scan_table(spark, root, "lineitem")
        .filter(F.col("l_suppkey") % 10 == 0)
        .select(
            _line_id().alias("card_id"),
            F.col("l_orderkey").alias("disp_id"),
            F.to_date("l_shipdate").alias("issued"),
            _pick(F.col("l_partkey") % 3, ["classic", "Gold", "junior"]).alias("type"),
        )
    )


def districts(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("n_nationkey")
    region = scan_table(spark, root, "region")
    return (
        scan_table(spark, root, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("A1"),
            F.col("n_name").alias("A2"),
            F.col("r_name").alias("A3"),
            (8000 + k * 150).alias("A11"),
            F.when(k == 7, "?").otherwise(_text(k + 1)).alias("A12"),
            F.when(k == 7, "?").otherwise(_text(k * 10)).alias("A15"),
        )
    )


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The events table as a change stream, ordered by ``seq``."""
    kind = (
        F.when(F.col("event_type") == "click", "PRIJEM")
        .when(F.col("event_type") == "purchase", "VYDAJ")
        .otherwise("VYBER")
    )
    return scan_table(spark, root, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("client_id"),
        kind.alias("type"),
        F.col("value").alias("amount"),
        "props",
    )


def bank(spark: SparkSession, root: str) -> Bank:
    return Bank(
        client=clients(spark, root),
        account=accounts(spark, root),
        disp=dispositions(spark, root),
        trans=transactions(spark, root),
        loan=loans(spark, root),
        order=orders(spark, root),
        card=cards(spark, root),
        district=districts(spark, root),
    )


def external_loans(spark: SparkSession, root: str) -> DataFrame:
    """Labelled loan book of another lender: every order with its purpose and size."""
    k = F.col("o_orderkey")
    customer = scan_table(spark, root, "customer").select("c_custkey", "c_acctbal")
    term = 12 * (1 + k % 5)
    return (
        scan_table(spark, root, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            k.alias("external_id"),
            (F.col("c_acctbal") * 12).alias("annual_income"),
            (F.col("c_acctbal") + F.col("o_totalprice")).alias("total_credit_utilized"),
            F.col("o_totalprice").alias("loan_amount"),
            (F.col("o_totalprice") / term).alias("installment"),
            term.cast("double").alias("term"),
            (k % 4).cast("double").alias("num_mort_accounts"),
            (k % 7).cast("double").alias("num_total_cc_accounts"),
            (F.col("c_acctbal") / F.col("o_totalprice")).alias("debt_to_income"),
            F.coalesce(_pick(k % 9, PURPOSE_BY_NINE), F.lit("other")).alias("loan_purpose"),
        )
    )
