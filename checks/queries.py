"""Every registered query: (spark, directory of parquet tables) -> DataFrame.

Numbers are rounded only here, so that sums taken in another order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerlens.functions import cleaning as C
from ledgerlens.functions import rules as R
from ledgerlens.functions import vectors as V
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import labels as L
from ledgerlens.operators import models as M
from ledgerlens.operators import neighbours as N
from ledgerlens.operators import profiling as P
from ledgerlens.operators import similarity as S
from ledgerlens.operators import splits as X
from ledgerlens.plans import batch_features as B
from ledgerlens.plans import lookalike as K
from ledgerlens.plans import propensity as Y
from ledgerlens.plans import purpose as U
from ledgerlens.plans import realtime_features as RT
from ledgerlens.plans import targeting as G
from ledgerlens.sources import json_rows as J
from ledgerlens.sources import roles, schemas, tables
from ledgerlens.sources.storage import cut_lineage, scratch_path
from ledgerlens.streaming import ingest, jobs
from ledgerlens.streaming.scoring import RunningTotals
from ledgerlens.streaming.state import StateTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ASOF = "1999-12-31"
COHORT_LABEL = 3
VEC = 64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Added before rounding: a mean of a few money values can end in an exact 5 at the fifth
# place, where the order of addition would decide the rounding. The SQL adds it as well.
NUDGE = 3.1415926535e-6


def asof() -> Column:
    return F.lit(ASOF).cast("date")


def tidy(df: DataFrame, digits: int = 4, fine: Sequence[str] = ()) -> DataFrame:
    """Round doubles (``fine`` columns to eight places), dates and arrays to text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
            c = F.round(c, 8) if f.name in fine else F.round(c + NUDGE, digits)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            items = c
            if isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
                items = F.transform(c, lambda x: F.round(x * 10000).cast("long"))
            c = F.array_join(items.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- scans and sinks ---------------------------------------------------------------


def _loan_text(spark: SparkSession, root: str) -> str:
    """The loan role as semicolon text with yymmdd dates, in the shared folder."""
    path = scratch_path(spark, "loan-text")
    loan = roles.loans(spark, root).select(
        "loan_id", "account_id", F.date_format("date", "yyMMdd").alias("date"), "amount",
        "duration", "payments", "status",
    )
    loan.write.option("header", True).option("sep", ";").option("quoteAll", True).csv(path)
    return path


@query
def scan_text(spark, root):
    df = tables.scan_text(spark, _loan_text(spark, root))
    amounts = [F.col(c).cast("double").alias(c) for c in ("amount", "payments")]
    return tidy(df.select("loan_id", "account_id", "date", "duration", "status", *amounts))


@query
def scan_typed(spark, root):
    return tidy(tables.scan_typed(spark, _loan_text(spark, root), schemas.LOAN))


@query
def scan_csv(spark, root):
    path = scratch_path(spark, "disp-csv")
    tables.write_csv(roles.dispositions(spark, root), path)
    return tables.scan_csv(spark, path, schemas.DISP)


@query
def scan_declared(spark, root):
    path = scratch_path(spark, "events-csv")
    tables.write_csv(_scoring_rows(spark, root), path)
    events = tables.scoring_events(spark, path)
    return tidy(events.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"),
        F.min("birth_number").alias("birth_number"), F.max("frequency").alias("frequency"),
    ))


@query
def discovered_tables(spark, root):
    """Tables found by their folder, row by row."""
    base = scratch_path(spark, "discover")
    bank = roles.bank(spark, root)
    for name in ("disp", "district", "card"):
        tables.write_csv(bank.tables()[name], f"{base}/{name}", sep=";")
    found = tables.discover_tables(spark, base, pattern="*.csv", by_folder=True)
    shown = {"disp": ("disp_id", "client_id", "account_id", "type"), "district": ("A1", "A2", "A3"),
             "card": ("disp_id", "type")}
    rows = [
        df.select(F.lit(name).alias("table_name"), F.concat_ws("|", *shown[name]).alias("row"))
        for name, df in found.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def header_trim(spark, root):
    df = roles.dispositions(spark, root)
    padded = df.toDF(*[f" {c} " for c in df.columns])
    return tables.trim_headers(padded)


@query
def limit_scan(spark, root):
    t = roles.transactions(spark, root).select("trans_id", "account_id", "type", "amount")
    return tidy(tables.first_rows(t, 500, "account_id", "trans_id"))


@query
def convert_tables(spark, root):
    source = _loan_text(spark, root)
    return tables.convert_tables(
        spark, {"loan": source, "missing": source + "-none"}, scratch_path(spark, "converted")
    )


@query
def csv_sink(spark, root):
    path = scratch_path(spark, "labels-csv")
    tables.write_csv(L.card_labels(roles.cards(spark, root), roles.dispositions(spark, root)), path)
    return tables.scan_csv(spark, path, schemas.CARD_LABELS)


_EVENT = T.StructType([T.StructField("k", T.LongType())])


@query
def json_decode(spark, root):
    decoded = J.decode_rows(roles.changes(spark, root), "props", _EVENT)
    return decoded.select("seq", F.col("row.k").alias("k"))


@query
def json_quarantine(spark, root):
    noisy = roles.changes(spark, root).withColumn(
        "props", F.when(F.col("type") == "VYBER", F.substring("props", 1, 4)).otherwise(F.col("props"))
    )
    good, bad = J.split_bad(J.decode_rows(noisy, "props", _EVENT), ("seq",))
    return good.select("seq", "k", F.lit(None).cast("string").alias("bad_message")).unionByName(
        bad.select("seq", F.lit(None).cast("long").alias("k"), "bad_message")
    )


@query
def json_encode(spark, root):
    """Encoded and decoded again: the round trip gives the rows back."""
    labels = L.card_labels(roles.cards(spark, root), roles.dispositions(spark, root))
    messages = J.encode_rows(labels, key="client_id")
    rows, _ = J.split_bad(J.decode_rows(messages, "value", schemas.CARD_LABELS))
    return rows


@query
def purpose_default(spark, root):
    loan, disp = roles.loans(spark, root), roles.dispositions(spark, root)
    return L.loan_labels(loan, disp, [None])


# --- cleaning ----------------------------------------------------------------------


@query
def coerce_numeric(spark, root):
    d = roles.districts(spark, root)
    filled = C.coerce_numeric(d, ["A12", "A15", "A99"])
    return C.coerce_numeric(filled.withColumn("A2_number", F.col("A2")), ["A2_number"], fill=0)


_USD_FINE = ("amount", "balance", "payments")


@query
def to_usd(spark, root):
    t = roles.transactions(spark, root).select("trans_id", "amount", "balance")
    return tidy(C.to_usd(t, ["amount", "balance", "absent"]), fine=_USD_FINE)


def _yymmdd_text(root_date: str) -> Column:
    return F.date_format(F.col(root_date), "yyMMdd")


@query
def parse_yymmdd(spark, root):
    """Ship dates as text, shifted over the century pivot, some of them impossible."""
    t = roles.transactions(spark, root).withColumn(
        "text",
        F.when(F.col("type") == "VYBER", F.concat(F.lit("7002"), F.lpad(F.dayofmonth("date"), 2, "0")))
        .when(F.col("type") == "VYDAJ", F.concat(F.lit("68"), F.date_format("date", "MMdd")))
        .otherwise(_yymmdd_text("date")),
    )
    parsed = C.parse_yymmdd(F.col("text"))
    return t.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(
        "text", "n", parsed.cast("string").alias("parsed")
    )


@query
def parse_yymmdd_ts(spark, root):
    text = F.date_format("ts", "yyMMdd HH:mm:ss")
    odd = F.when(F.col("type") == "VYBER", F.concat(F.lit("99"), F.substring(text, 3, 20)))
    rows = roles.changes(spark, root).select("seq", F.coalesce(odd, text).alias("text"))
    parsed = F.date_format(C.parse_yymmdd_ts(F.col("text")), "yyyy-MM-dd HH:mm:ss")
    return rows.select("seq", parsed.alias("parsed"))


@query
def null_fill(spark, root):
    t = roles.transactions(spark, root).select("trans_id", "k_symbol")
    return C.fill_nulls(t, {"k_symbol": "", "account": "", "district_id": 0})


@query
def coalesce_district(spark, root):
    c = roles.clients(spark, root).select(
        "client_id", F.when(F.col("district_id") % 3 != 0, F.col("district_id")).alias("own")
    )
    a = roles.accounts(spark, root).select("account_id", F.col("district_id").alias("of_account"))
    d = roles.dispositions(spark, root).select("disp_id", "client_id", "account_id")
    rows = d.join(c, "client_id", "left").join(a, "account_id", "left")
    return rows.select(
        "disp_id", G.coalesce_district(F.col("own"), F.col("of_account")).alias("district_id")
    )


@query
def project_reorder(spark, root):
    d = roles.districts(spark, root).withColumnRenamed("A1", "district_id")
    return C.select_or_default(d, {"A3": "", "district_id": 0, "A2": "", "A16": 0})


@query
def sentinel_to_zero(spark, root):
    return RT.district_features(roles.districts(spark, root)).withColumnRenamed("_district", "key")


@query
def birth_age(spark, root):
    c = roles.clients(spark, root)
    return c.select(
        "client_id",
        C.birth_date(F.col("birth_number")).cast("string").alias("born"),
        C.age_years(F.col("birth_number"), asof()).alias("age"),
    )


@query
def purpose_flags(spark, root):
    return L.with_purpose_flags(roles.loans(spark, root).select("loan_id", "loan_purpose"))


@query
def purpose_priority(spark, root):
    flagged = L.with_purpose_flags(roles.loans(spark, root).select("loan_id", "loan_purpose"))
    return flagged.select("loan_id", L.main_purpose().alias("main_purpose"))


@query
def owner_only(spark, root):
    return A.owner_accounts(roles.dispositions(spark, root))


@query
def numeric_columns(spark, root):
    loan = roles.loans(spark, root)
    return tidy(loan.select(*C.numeric_columns(loan)))


@query
def table_preview(spark, root):
    return P.preview(roles.loans(spark, root).select("loan_id", "status"), 5, "loan_id")


# --- joins -------------------------------------------------------------------------


@query
def district_join(spark, root):
    c = roles.clients(spark, root).select("client_id", "district_id")
    return B.with_district(c, roles.districts(spark, root))


@query
def client_accounts(spark, root):
    return tidy(A.client_accounts(roles.dispositions(spark, root)))


@query
def client_ids(spark, root):
    ids = ["client_id", *B.ID_COLUMNS]
    return B.client_features_with_ids(roles.bank(spark, root)).select(*ids)


@query
def client_id_rows(spark, root):
    return B.client_id_rows(roles.bank(spark, root))


@query
def knn_label(spark, root):
    features = _usd_features(spark, root)
    external = roles.external_loans(spark, root)
    found = N.nearest_label(
        features, external, query_id="client_id", labelled_id="external_id",
        label="loan_purpose", pairs=U.PURPOSE_PAIRS,
    )
    return found.select(
        F.col("qid").alias("client_id"), F.col("nid").alias("external_id"),
        F.col("label").alias("loan_purpose"), F.round("distance", 6).alias("distance"),
    )


@query
def purpose_master(spark, root):
    out = U.with_purpose(_usd_features(spark, root), roles.external_loans(spark, root))
    return out.select("client_id", "loan_purpose", "num_loans", "num_cards")


def _usd_features(spark, root):
    return B.client_features_with_ids(roles.bank(spark, root), card_stats=True, usd=True)


# --- aggregates --------------------------------------------------------------------


@query
def trans_basic(spark, root):
    return tidy(A.trans_basic(roles.transactions(spark, root)))


@query
def trans_enhanced(spark, root):
    return tidy(A.trans_enhanced(roles.transactions(spark, root)), fine=("balance_median",))


@query
def trans_derived(spark, root):
    out = A.trans_derived(A.trans_enhanced(roles.transactions(spark, root)))
    extra = [c for c in out.columns if c.endswith(("_ratio", "_volatility", "_frequency"))]
    return tidy(out.select("account_id", "net_cashflow", "avg_transaction_amount", *extra))


@query
def loan_summary(spark, root):
    return tidy(A.loan_summary(roles.loans(spark, root)))


@query
def order_summary(spark, root):
    return tidy(A.order_summary(roles.orders(spark, root)))


@query
def card_summary(spark, root):
    return tidy(A.card_summary(roles.cards(spark, root), roles.dispositions(spark, root)))


@query
def trans_agg_last(spark, root):
    return tidy(A.trans_agg_last(roles.transactions(spark, root)))


@query
def card_labels(spark, root):
    return L.card_labels(
        roles.cards(spark, root), roles.dispositions(spark, root), ignore_case=True
    )


@query
def loan_labels(spark, root):
    loan = roles.loans(spark, root)
    purposes = loan.select("account_id", "loan_purpose")
    return L.loan_labels(loan, roles.dispositions(spark, root), [None, purposes])


@query
def loan_labels_matched(spark, root):
    """Loan labels whose purpose is that of the nearest loan of another lender."""
    disp = roles.dispositions(spark, root)
    purposes = U.with_purpose(_usd_features(spark, root), roles.external_loans(spark, root))
    found = L.purposes_of_accounts(purposes, disp)
    return L.loan_labels(roles.loans(spark, root), disp, [found], unmatched="unknown")


@query
def loan_label_totals(spark, root):
    return P.flag_totals(loan_labels(spark, root), list(L.PURPOSE_KEYWORDS))


@query
def value_counts(spark, root):
    return P.value_counts(roles.transactions(spark, root), "k_symbol")


@query
def null_profile(spark, root):
    return P.null_profile(roles.transactions(spark, root))


@query
def describe_numeric(spark, root):
    t = roles.transactions(spark, root).select("amount", "balance")
    out = P.describe_numeric(t, ["amount", "balance"])
    return tidy(out, fine=("min", "max", "q25", "q50", "q75"))


# --- client features ---------------------------------------------------------------


@query
def client_360(spark, root):
    return tidy(B.client_360(roles.bank(spark, root), 5))


@query
def client_features_v1(spark, root):
    return tidy(B.client_features_v1(roles.bank(spark, root)))


@query
def client_features_batch(spark, root):
    return tidy(B.client_features(roles.bank(spark, root)), fine=FINE_BATCH)


@query
def client_features_filled(spark, root):
    return tidy(B.client_features(roles.bank(spark, root), fill=True), fine=FINE_BATCH)


@query
def client_features_ids(spark, root):
    return tidy(B.client_features_with_ids(roles.bank(spark, root)), fine=FINE_BATCH)


@query
def client_features_cards(spark, root):
    df = B.client_features_with_ids(roles.bank(spark, root), card_stats=True)
    return tidy(df, fine=FINE_BATCH)


@query
def client_features_usd(spark, root):
    return tidy(_usd_features(spark, root), fine=FINE_USD)


@query
def client_features_rt(spark, root):
    bank = roles.bank(spark, root)
    labels = loan_labels(spark, root)
    return tidy(RT.realtime_features(bank, loan_labels=labels), fine=FINE_RT)


def _raw_bank(spark: SparkSession, root: str) -> roles.Bank:
    """The roles as semicolon text with yymmdd dates and columns in another order, read back."""
    base = scratch_path(spark, "raw-bank")
    layouts = {}
    for name, df in roles.bank(spark, root).tables().items():
        pattern = "yyMMdd '00:00:00'" if name == "card" else "yyMMdd"
        dated = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
        df = df.drop("date_int").withColumns({c: F.date_format(c, pattern) for c in dated})
        layouts[name] = df.schema
        tables.write_csv(df.select(*reversed(df.columns)), f"{base}/{name}", sep=";", compression="gzip")
    return roles.Bank(**tables.bank_tables(spark, base, suffix="", layouts=layouts, keep_empty=True))


@query
def raw_bank_features_batch(spark, root):
    return tidy(B.client_features(_raw_bank(spark, root)), fine=FINE_BATCH)


@query
def raw_bank_features_rt(spark, root):
    labels = loan_labels(spark, root)
    return tidy(RT.realtime_features(_raw_bank(spark, root), loan_labels=labels), fine=FINE_RT)


# Columns whose exact value has more than four decimals and no division behind it.
FINE_BATCH = ("balance_min", "balance_max")
FINE_USD = (
    "total_incoming", "total_outgoing", "net_cashflow", "max_incoming", "max_outgoing",
    "min_incoming", "min_outgoing", "balance_min", "balance_max", "loan_amount_total_usd",
    "loan_amount_max_usd", "loan_amount_min_usd", "total_order_amount_usd",
    "max_order_amount_usd", "min_order_amount_usd",
)
FINE_RT = (*FINE_USD, "median_incoming", "median_outgoing", "balance_median")


# --- splits, order statistics ------------------------------------------------------


@query
def client_snapshot(spark, root):
    return tidy(K.client_snapshot(roles.bank(spark, root)))


@query
def chrono_split(spark, root):
    t = roles.transactions(spark, root).select("trans_id", "account_id", "date")
    return tidy(X.chrono_split(t, "account_id", "date", "trans_id"))


@query
def sample_fraction(spark, root):
    c = roles.clients(spark, root).select("client_id")
    return X.sample_fraction(c, ["client_id"], 0.3)


@query
def entity_split(spark, root):
    return X.entity_split(roles.clients(spark, root), "client_id")


@query
def dedupe_latest(spark, root):
    rows = roles.changes(spark, root).select("client_id", "seq", "type", "amount")
    return tidy(P.latest_per_key(rows, "client_id", "seq"))


@query
def first_row_per_account(spark, root):
    t = roles.transactions(spark, root).select("account_id", "trans_id", "amount")
    return tidy(P.first_per_key(t, "account_id", ["trans_id"]))


@query
def split_tables(spark, root):
    bank = roles.bank(spark, root).tables()
    bank["loan_labels"] = loan_labels(spark, root)
    halves = X.split_tables(bank)
    out = None
    for name, (present, stream) in sorted(halves.items()):
        for half, df in (("present", present), ("stream", stream)):
            row = df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("table_name"), F.lit(half).alias("half"), "n"
            )
            out = row if out is None else out.unionByName(row)
    return out


_ROW_KEYS = {
    "client": ("client_id",), "account": ("account_id",), "disp": ("disp_id",), "loan": ("loan_id",),
    "order": ("order_id",), "card": ("card_id",), "trans": ("trans_id",), "district": ("A1",),
    "loan_labels": ("client_id", "account_id"), "card_labels": ("client_id", "account_id", "disp_id"),
}


@query
def split_rows(spark, root):
    """Table, key and half of every row of the ten tables."""
    bank = roles.bank(spark, root).tables()
    bank["loan_labels"] = loan_labels(spark, root)
    bank["card_labels"] = card_labels(spark, root)
    parts = []
    for name, halves in X.split_tables(bank).items():
        for half, df in zip(("present", "stream"), halves):
            key = F.concat_ws("|", *_ROW_KEYS[name])
            parts.append(df.select(F.lit(name).alias("table_name"), key.alias("row_key"), F.lit(half).alias("half")))
    return reduce(DataFrame.unionByName, parts)


@query
def present_transactions(spark, root):
    """The present half of the fact table, row by row."""
    present, _ = X.split_tables(roles.bank(spark, root).tables())["trans"]
    return present.select("trans_id", "account_id")


@query
def train_test_split(spark, root):
    snap = K.client_snapshot(roles.bank(spark, root)).select("client_id", "has_home_loan")
    train, test = X.train_test(snap, "client_id", "has_home_loan")
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


# --- rules and decisions -----------------------------------------------------------


def _scoring_rows(spark, root):
    bank = roles.bank(spark, root)
    trans = bank.trans.withColumn("date", F.col("date_int").cast("long"))
    return G.scoring_rows(trans, bank.account, bank.disp, bank.client)


def _enriched(spark, root, rows=None):
    bank = roles.bank(spark, root)
    rows = _scoring_rows(spark, root) if rows is None else rows
    totals = A.trans_agg_last(bank.trans)
    return G.enrich_txn(rows, bank.client, bank.account, bank.district, totals, asof=asof())


@query
def enrich_txn(spark, root):
    out = _enriched(spark, root).select(
        "trans_id", "client_id", "district_id", "age", "balance", "avg_balance", "income",
        "txn_count", "activity_score", "has_employment", "has_default", "account_frequency",
    )
    return tidy(out)


@query
def eligibility(spark, root):
    rules = dict(R.HOME_LOAN_RULES, employment_required=False, reject_previous_default=True)
    strict = {"max_age": 50, "min_balance": 20000, "employment_required": True}
    return _enriched(spark, root).select(
        "trans_id", R.eligible(R.HOME_LOAN_RULES).alias("home_loan"),
        R.eligible(rules).alias("no_default"), R.eligible(strict).alias("strict"),
    )


@query
def ineligible_reasons(spark, root):
    e = _enriched(spark, root).filter(~R.eligible(R.HOME_LOAN_RULES))
    return e.select("trans_id", R.ineligible_reasons(R.HOME_LOAN_RULES).alias("reasons"))


@query
def rule_score(spark, root):
    e = _enriched(spark, root).withColumn("score", R.rule_score())
    return tidy(e.select("trans_id", "score", R.accepts(F.col("score")).alias("accepted")))


@query
def decision_line(spark, root):
    return G.decide(_enriched(spark, root)).select("trans_id", "output")


# --- look-alike --------------------------------------------------------------------


@query
def feature_vector(spark, root):
    snap = K.with_vector(K.client_snapshot(roles.bank(spark, root)), asof())
    named = [F.col("features")[i].alias(n) for i, n in enumerate(K.VECTOR_FEATURES)]
    return tidy(snap.select("client_id", *named))


@query
def standardize(spark, root):
    snap = K.with_vector(K.client_snapshot(roles.bank(spark, root)), asof())
    cohort = snap.filter(F.col("has_home_loan") == 1)
    scaler = S.fit_scaler([snap, cohort], "features", K.WIDTH)
    out = S.standardize(snap, "features", scaler, K.WIDTH)
    named = [F.col("features")[i].alias(n) for i, n in enumerate(K.VECTOR_FEATURES)]
    return tidy(out.select("client_id", *named))


def _embeddings(spark, root):
    return tables.scan_table(spark, root, "embeddings")


@query
def l2_normalize(spark, root):
    e = V.with_unit(_embeddings(spark, root), "embedding", VEC, name="u")
    # written once: exploding the unread expression would work it out for each position
    unit = cut_lineage(e.select("vec_id", "u"))
    return tidy(unit.select("vec_id", F.posexplode("u").alias("position", "component")))


def _ranked(spark, root):
    e = _embeddings(spark, root).withColumn("y", C.flag(F.col("label") == COHORT_LABEL))
    return S.cohort_similarity(e, e.filter(F.col("y") == 1), "embedding", VEC)


@query
def rank_similarity(spark, root):
    r = S.rank_by_score(_ranked(spark, root), "similarity_score", "vec_id")
    r = r.withColumn("unit_score", V.to_unit_interval(F.col("similarity_score")))
    return r.select(
        "vec_id", "label", F.round("similarity_score", 6).alias("similarity_score"),
        F.round("unit_score", 3).alias("unit_score"),
    )


@query
def top_targets(spark, root):
    out = S.top_targets(_ranked(spark, root), "similarity_score", "vec_id")
    return out.select("vec_id", "y", F.round("similarity_score", 6).alias("similarity_score"))


@query
def precision_at_k(spark, root):
    return tidy(S.precision_at_k(_ranked(spark, root), "similarity_score", "y", "vec_id"))


@query
def cohort_eval(spark, root):
    return tidy(S.cohort_eval(_ranked(spark, root), "similarity_score", "y", "vec_id"))


@query
def class_means(spark, root):
    return tidy(S.class_means(_ranked(spark, root), "y", "similarity_score"))


@query
def lookalike_targets(spark, root):
    out = K.target_list(roles.bank(spark, root), asof())
    return out.select("client_id", F.round("similarity_score", 6).alias("similarity_score"))


@query
def embedding_inference(spark, root):
    """Ten inputs to 128, 64 and 64 outputs with weights from a fixed seed."""
    rng = np.random.default_rng(7)
    sizes = (K.WIDTH, 128, 64, 64)
    layers = [(rng.normal(0, a**-0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    snap = K.with_vector(K.client_snapshot(roles.bank(spark, root)), asof())
    cohort = snap.filter(F.col("has_home_loan") == 1)
    out = K.lookalike_scores(snap, cohort, [snap, cohort], layers=layers)
    return out.select("client_id", F.round("similarity_score", 6).alias("similarity_score"))


# --- models ------------------------------------------------------------------------


def _judged(spark, root):
    """Rule decisions set against actual loans: a label and a prediction per client."""
    e = G.decide(_enriched(spark, root)).filter(F.col("client_id") > 0)
    decided = e.groupBy("client_id").agg(F.max(F.col("accepted").cast("int")).alias("prediction"))
    snap = K.client_snapshot(roles.bank(spark, root)).select("client_id", "has_home_loan")
    return snap.join(decided, "client_id")


@query
def confusion(spark, root):
    return M.confusion(_judged(spark, root), "has_home_loan", "prediction")


@query
def classification_report(spark, root):
    return tidy(M.classification_report(_judged(spark, root), "has_home_loan", "prediction"))


@query
def regression_error(spark, root):
    """Error of the account's mean amount as a predictor of each transaction amount."""
    t = roles.transactions(spark, root)
    means = A.trans_agg_model(t).select("account_id", "amount_mean")
    rows = t.join(means, "account_id").select(
        (F.col("amount") / 1000).alias("y"), (F.col("amount_mean") / 1000).alias("p")
    )
    return tidy(M.regression_error(rows, "y", "p"))


_FITTED: dict = {}


def _propensity(spark, root):
    """The two forests of a data set, fitted once for the queries that report on them."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = Y.fit_propensity(roles.bank(spark, root), trees=200)
    return _FITTED[key]


@query
def propensity_report(spark, root):
    """Precision, recall, F1 and accuracy by class, on the rows fitted and on those held back."""
    fitted = _propensity(spark, root)
    parts = [
        M.classification_report(df, "loan_taker", "predicted_taker").withColumn("part", F.lit(name))
        for name, df in (("train", fitted.train), ("test", fitted.test))
    ]
    return tidy(parts[0].unionByName(parts[1]))


@query
def propensity_support(spark, root):
    """Rows of each part and class, and whether the report's counts add up."""
    fitted = _propensity(spark, root)
    out = []
    for name, df in (("train", fitted.train), ("test", fitted.test)):
        report = M.classification_report(df, "loan_taker", "predicted_taker")
        whole = M.confusion(df, "loan_taker", "predicted_taker").agg(F.sum("n")).scalar()
        fits = F.col("accuracy").between(0, 1) & F.col("precision").between(0, 1) & (F.col("support") <= whole)
        out.append(
            report.where("support > 0").select(F.lit(name).alias("part"), "class", "support", fits.alias("fits"))
        )
    return out[0].unionByName(out[1])


@query
def amount_model(spark, root):
    fitted = _propensity(spark, root)
    test = M.with_residual(fitted.test, "loan_amount", "predicted_amount")
    return tidy(test.select("disp_id", "loan_amount", "predicted_amount", "residual"))


@query
def amount_residuals(spark, root):
    """The rows held back with their amount; prediction and residual have to add up to it, and the
    forest has to predict within the amounts it has seen."""
    fitted = _propensity(spark, root)
    test = M.with_residual(fitted.test, "loan_amount", "predicted_amount")
    most = fitted.train.agg(F.max("loan_amount")).scalar()
    adds_up = F.abs(F.col("predicted_amount") + F.col("residual") - F.col("loan_amount")) < 1e-6
    within = F.col("predicted_amount").between(0, most + F.lit(1e-6))
    rows = test.select("disp_id", "loan_amount", "loan_taker", (adds_up & within).alias("adds_up"))
    return tidy(rows)


@query
def amount_error(spark, root):
    """Mean squared error of the amount forest on the rows fitted and on those held back."""
    fitted = _propensity(spark, root)
    parts = [
        M.regression_error(df, "loan_amount", "predicted_amount").withColumn("part", F.lit(name))
        for name, df in (("train", fitted.train), ("test", fitted.test))
    ]
    return tidy(parts[0].unionByName(parts[1]))


@query
def feature_importance(spark, root):
    fitted = _propensity(spark, root)
    return tidy(M.feature_importance(fitted.classifier, fitted.features))


# --- streaming ---------------------------------------------------------------------


def _event_stream(spark, root):
    schema = tables.scan_table(spark, root, "events").schema
    raw = ingest.table_stream(spark, root, schema, fmt="parquet", glob="events.parquet")
    kind = F.when(F.col("event_type") == "click", "PRIJEM").when(
        F.col("event_type") == "purchase", "VYDAJ"
    ).otherwise("VYBER")
    return raw.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("client_id"), kind.alias("type"),
        F.col("value").alias("amount"),
    )


@query
def stream_totals(spark, root):
    state = StateTable(spark, scratch_path(spark, "totals"), "client_id", "last_seq")
    totals = jobs.running_totals(_event_stream(spark, root), "client_id")
    jobs.start(totals, jobs.upsert_into(state), mode="update").awaitTermination()
    return tidy(state.read())


@query
def state_upsert(spark, root):
    state = StateTable(spark, scratch_path(spark, "state"), "client_id", "seq")
    jobs.start(_event_stream(spark, root), jobs.upsert_into(state)).awaitTermination()
    return tidy(state.read())


@query
def stream_score(spark, root):
    """Every transaction scored as it arrives, and audited as CSV."""
    source, audit = scratch_path(spark, "score-in"), scratch_path(spark, "audit")
    tables.write_csv(_stream_rows(spark, root), source, compression="gzip")
    events = ingest.table_stream(spark, source, STREAM_ROW, fmt="csv")
    scored = G.decide(_enriched(spark, root, events)).select("row_key", "output")
    jobs.start(scored, jobs.audit_csv(audit, compression="gzip")).awaitTermination()
    return spark.read.schema("row_key string, output string").option("header", True).csv(audit).select(
        "row_key", "output"
    )


def _followed(spark, root, start: roles.Bank, changes: list[tuple[str, DataFrame]]) -> DataFrame:
    """Features of a store that began with ``start`` and took in ``changes``, one micro-batch each."""
    store = jobs.FeatureStore(spark, scratch_path(spark, "store"), compact_every=2)
    store.bootstrap(start, loan_labels(spark, root))
    source = scratch_path(spark, "messages")
    for at, (name, rows) in enumerate(changes):
        messages = rows.select(
            F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns)).alias("value"),
            F.lit(at).cast("long").alias("seq"),
        )
        messages.write.mode("append").parquet(source)
        stream = ingest.table_stream(spark, source, messages.schema, fmt="parquet")
        work = store.follow({name: df.schema for name, df in changes})
        # the same checkpoint goes on where the run before stopped
        jobs.start(stream, work, checkpoint=f"{store.path}/progress").awaitTermination()
    return tidy(store.features.read().drop("_seq"), fine=FINE_RT)


@query
def store_follow(spark, root):
    """Transactions up to mid-1998 are there at the start, the rest comes in three micro-batches."""
    bank = roles.bank(spark, root)
    years = [F.lit(d).cast("date") for d in CUTS]
    early = bank.trans.where(F.col("date").isNull() | (F.col("date") <= years[0]))
    late = [bank.trans.where((F.col("date") > a) & (F.col("date") <= b)) for a, b in zip(years, years[1:])]
    late.append(bank.trans.where(F.col("date") > years[-1]))
    return _followed(spark, root, replace(bank, trans=early), [("trans", df) for df in late])


@query
def store_moved_disposition(spark, root):
    """Every disponent's disposition moves to the neighbouring client."""
    bank = roles.bank(spark, root)
    moved = bank.disp.where(F.col("type") == "DISPONENT").withColumn(
        "client_id", F.col("client_id") + F.when(F.col("client_id") % 2 == 1, 1).otherwise(-1)
    )
    return _followed(spark, root, bank, [("disp", moved.select(*bank.disp.columns))])


CUTS = ("1998-06-30", "1999-12-31", "2000-12-31")


@query
def stream_score_running(spark, root):
    """Each transaction after mid-1998 scored against the totals of all that came before its batch."""
    bank = roles.bank(spark, root)
    audit, source = scratch_path(spark, "audit"), scratch_path(spark, "score-in")
    state = RunningTotals(spark, scratch_path(spark, "running"), date="day", compact_every=2)
    cuts = [F.lit(d).cast("date") for d in CUTS]
    history = bank.trans.withColumnRenamed("date", "day")
    state.seed(history.where(F.col("day").isNull() | (F.col("day") <= cuts[0])))
    rows = _scoring_rows(spark, root).withColumn(
        "day", C.parse_yymmdd(F.lpad(F.col("date").cast("string"), 6, "0"))
    )
    # joined once and not again for each part
    late = scratch_path(spark, "score-rows")
    rows.where(F.col("day") > cuts[0]).write.parquet(late)
    rows = spark.read.parquet(late)

    def score(batch: DataFrame, totals: DataFrame) -> DataFrame:
        enriched = G.enrich_txn(batch, bank.client, bank.account, bank.district, totals, asof=asof())
        return G.decide(enriched).select("trans_id", "output")

    work = state.follow(score, jobs.audit_csv(audit))
    for low, high in zip(cuts, [*cuts[1:], None]):
        part = rows.where(F.col("day") > low)
        part = part if high is None else part.where(F.col("day") <= high)
        part.write.mode("append").parquet(source)
        stream = ingest.table_stream(spark, source, rows.schema, fmt="parquet")
        jobs.start(stream, work, checkpoint=f"{state.path}/progress").awaitTermination()
    written = spark.read.schema("trans_id string, output string").option("header", True).csv(audit)
    return written.select("trans_id", "output")


STREAM_ROW = T.StructType(
    [T.StructField("row_key", T.StringType())]
    + [f for f in schemas.SCORING_EVENT.fields if f.name != "trans_id"]
)


def _stream_rows(spark, root):
    rows = _scoring_rows(spark, root).withColumnRenamed("trans_id", "row_key")
    return rows.select(*[f.name for f in STREAM_ROW.fields])
