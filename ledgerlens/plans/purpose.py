"""Purpose-labelled master table: client features with the purpose of the nearest loan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.neighbours import nearest_label

# Which client measure is compared with which measure of the external book.
PURPOSE_PAIRS = (
    ("balance_mean", "annual_income"),
    ("total_incoming", "total_credit_utilized"),
    ("total_outgoing", "loan_amount"),
    ("loan_amount_total_usd", "installment"),
    ("loan_payment_avg_usd", "term"),
    ("loan_duration_avg", "num_mort_accounts"),
    ("num_loans", "num_total_cc_accounts"),
    ("num_cards", "debt_to_income"),
)


def with_purpose(features: DataFrame, external: DataFrame, **options) -> DataFrame:
    """Add ``loan_purpose`` from the nearest external loan to each client row.

    The two original feature lists differ in length; the first eight pairs are used.
    """
    found = nearest_label(
        features, external, query_id="client_id", labelled_id="external_id",
        label="loan_purpose", pairs=PURPOSE_PAIRS, **options,
    )
    found = found.select(F.col("qid").alias("client_id"), F.col("label").alias("loan_purpose"))
    return features.join(found, "client_id", "left").fillna({"loan_purpose": "unknown"})
