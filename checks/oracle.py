"""The SQL (DuckDB dialect) each registered query is compared with, written on its own."""

from __future__ import annotations

ROLES = """
WITH r_client AS (
  SELECT c_custkey AS client_id, c_nationkey AS district_id,
    CASE WHEN c_custkey % 97 = 0 THEN '999' WHEN c_custkey % 89 = 0 THEN '700231'
      ELSE lpad((10 + c_custkey % 80)::VARCHAR, 2, '0')
        || lpad((1 + c_custkey % 12 + 50 * (c_custkey % 2))::VARCHAR, 2, '0')
        || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') END AS birth_number
  FROM customer),
r_disp AS (
  SELECT o_orderkey AS disp_id, o_custkey AS client_id, o_orderkey AS account_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'DISPONENT' ELSE 'OWNER' END AS type
  FROM orders),
r_account AS (
  SELECT o_orderkey AS account_id, c_nationkey AS district_id, o_orderpriority AS frequency,
    o_orderdate::DATE AS date
  FROM orders JOIN customer ON o_custkey = c_custkey),
r_trans AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(l_extendedprice * 100)::BIGINT) AS trans_id,
    l_orderkey AS account_id, l_shipdate::DATE AS date,
    ((year(l_shipdate) % 100) * 10000 + month(l_shipdate) * 100 + day(l_shipdate))::INT AS date_int,
    CASE l_returnflag WHEN 'A' THEN 'PRIJEM' WHEN 'R' THEN 'VYDAJ' ELSE 'VYBER' END AS type,
    l_linestatus AS operation, l_extendedprice AS amount,
    l_extendedprice * (1 - l_discount) - 20000 AS balance,
    CASE l_linenumber % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL
      ELSE 'K' || (l_linenumber % 5)::VARCHAR END AS k_symbol,
    'B' || (l_suppkey % 13)::VARCHAR AS bank
  FROM lineitem),
r_loan AS (
  SELECT o_orderkey AS loan_id, o_orderkey AS account_id, o_orderdate::DATE AS date,
    ((year(o_orderdate) % 100) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INT AS date_int,
    o_totalprice AS amount, (12 * (1 + o_orderkey % 5))::INT AS duration,
    o_totalprice / (12 * (1 + o_orderkey % 5)) AS payments,
    CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS status,
    CASE o_orderkey % 9 WHEN 0 THEN 'car' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'debt_consolidation'
      WHEN 3 THEN 'home_improvement' WHEN 4 THEN 'major_purchase' WHEN 5 THEN 'medical'
      WHEN 6 THEN 'small_business' WHEN 7 THEN 'unknown' END AS loan_purpose
  FROM orders WHERE o_orderstatus = 'F'),
r_order AS (
  SELECT trans_id AS order_id, account_id, bank AS bank_to, amount, k_symbol
  FROM r_trans WHERE type = 'VYBER' AND operation = 'O'),
r_card AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(l_extendedprice * 100)::BIGINT) AS card_id,
    l_orderkey AS disp_id, l_shipdate::DATE AS issued,
    CASE l_partkey % 3 WHEN 0 THEN 'classic' WHEN 1 THEN 'Gold' ELSE 'junior' END AS type
  FROM lineitem WHERE l_suppkey % 10 = 0),
r_district AS (
  SELECT n_nationkey AS "A1", n_name AS "A2", r_name AS "A3", 8000 + n_nationkey * 150 AS "A11",
    CASE WHEN n_nationkey = 7 THEN '?' ELSE (n_nationkey + 1)::VARCHAR END AS "A12",
    CASE WHEN n_nationkey = 7 THEN '?' ELSE (n_nationkey * 10)::VARCHAR END AS "A15"
  FROM nation JOIN region ON n_regionkey = r_regionkey),
r_stream AS (
  SELECT event_id AS seq, ts, user_id AS client_id,
    CASE event_type WHEN 'click' THEN 'PRIJEM' WHEN 'purchase' THEN 'VYDAJ' ELSE 'VYBER' END AS type,
    value AS amount, props
  FROM events)
"""

ORACLE: dict[str, str] = {}

# Added before rounding to four places on both sides: means of a few money values end in an
# exact 5 at the fifth place, where the order of addition would decide the rounding.
NUDGE = "3.1415926535e-6"


def put(name: str, body: str, ctes: str = "") -> None:
    ORACLE[name] = ROLES + (", " + ctes if ctes else "") + "\n" + body


def rnd(columns: str, digits: int = 4, alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    shift = f" + {NUDGE}" if digits == 4 else ""
    return ", ".join(f"round({dot}{c}{shift}, {digits}) AS {c}" for c in columns.split())


def text(columns: str, alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return ", ".join(f"{dot}{c}::VARCHAR AS {c}" for c in columns.split())


def distinct_list(c: str) -> str:
    return f"coalesce(string_agg(DISTINCT {c}::VARCHAR, ',' ORDER BY {c}::VARCHAR), '')"


# --- scans -------------------------------------------------------------------------

put("scan_text", f"""SELECT loan_id::VARCHAR AS loan_id, account_id::VARCHAR AS account_id,
  strftime(date, '%y%m%d') AS date, duration::VARCHAR AS duration, status, {rnd('amount payments')} FROM r_loan""")
put("scan_typed", f"""SELECT loan_id, account_id, strftime(date, '%y%m%d') AS date,
  {rnd('amount payments')}, duration, status FROM r_loan""")
put("scan_csv", "SELECT * FROM r_disp")
put("header_trim", 'SELECT disp_id, client_id, account_id, type FROM r_disp')
put("discovered_tables", """SELECT 'disp' AS table_name, concat_ws('|', disp_id, client_id, account_id, type) AS row FROM r_disp
  UNION ALL SELECT 'district', concat_ws('|', "A1", "A2", "A3") FROM r_district
  UNION ALL SELECT 'card', concat_ws('|', disp_id, type) FROM r_card""")
put("limit_scan", """SELECT trans_id, account_id, type, round(amount + 3.1415926535e-6, 4) AS amount FROM r_trans
  ORDER BY account_id, trans_id LIMIT 500""")
put("convert_tables", """SELECT 'loan' AS table_name, count(*) AS row_count, 7 AS column_count,
  NULL AS error FROM r_loan UNION ALL SELECT 'missing', NULL, NULL, 'PATH_NOT_FOUND'""")
put("json_decode", "SELECT seq, (props->>'k')::BIGINT AS k FROM r_stream")
put("json_quarantine", """SELECT seq, CASE WHEN type <> 'VYBER' THEN (props->>'k')::BIGINT END AS k,
  CASE WHEN type = 'VYBER' THEN substr(props, 1, 4) END AS bad_message FROM r_stream""")

SCORING = """s_rows AS (
  SELECT t.trans_id, t.account_id, t.amount, t.balance, t.type, t.operation,
    coalesce(t.k_symbol, '') AS k_symbol, t.bank,
    coalesce(h.client_id, 0) AS client_id,
    coalesce(c.district_id, h.district_id, 0) AS district_id,
    coalesce(h.frequency, '') AS frequency, coalesce(c.birth_number, '') AS birth_number
  FROM r_trans t
  LEFT JOIN (SELECT d.account_id, d.client_id, a.frequency, a.district_id
             FROM r_disp d JOIN r_account a USING (account_id) WHERE d.type = 'OWNER') h
    ON h.account_id = t.account_id
  LEFT JOIN r_client c ON c.client_id = h.client_id)"""

put("scan_declared", """SELECT client_id, count(*) AS n, round(sum(amount) + 3.1415926535e-6, 4) AS amount,
  min(birth_number) AS birth_number, max(frequency) AS frequency
  FROM s_rows GROUP BY client_id""", SCORING)
put("purpose_default", """SELECT d.client_id, l.account_id, d.disp_id, 'unknown' AS loan_purpose,
  0 AS personal_loan, 0 AS car_loan, 0 AS home_loan, 0 AS credit_card_loan, 0 AS business_loan
  FROM r_loan l LEFT JOIN (SELECT * FROM r_disp WHERE type = 'OWNER') d USING (account_id)""")

# --- cleaning ----------------------------------------------------------------------

put("coerce_numeric", """SELECT "A1", "A2", "A3", "A11", try_cast("A12" AS DOUBLE) AS "A12",
  try_cast("A15" AS DOUBLE) AS "A15", 0::DOUBLE AS "A2_number" FROM r_district""")
put("to_usd", """SELECT trans_id, round(amount * 0.038::DOUBLE, 8) AS amount,
  round(balance * 0.038::DOUBLE, 8) AS balance FROM r_trans""")
put("parse_yymmdd", """SELECT text, count(*) AS n,
    try_cast(CASE WHEN substr(text, 1, 2)::INT >= 69 THEN '19' ELSE '20' END
      || substr(text, 1, 2) || '-' || substr(text, 3, 2) || '-' || substr(text, 5, 2) AS DATE)::VARCHAR AS parsed
  FROM (SELECT CASE type WHEN 'VYBER' THEN '7002' || lpad(day(date)::VARCHAR, 2, '0')
      WHEN 'VYDAJ' THEN '68' || strftime(date, '%m%d') ELSE strftime(date, '%y%m%d') END AS text
    FROM r_trans) GROUP BY text""")
put("parse_yymmdd_ts", """SELECT seq, CASE WHEN type = 'VYBER' THEN '1999' ELSE strftime(ts, '%Y') END
  || strftime(ts, '-%m-%d %H:%M:%S') AS parsed FROM r_stream""")
put("null_fill", """SELECT trans_id, coalesce(k_symbol, '') AS k_symbol, '' AS account,
  0 AS district_id FROM r_trans""")
put("coalesce_district", """SELECT d.disp_id,
  coalesce(CASE WHEN c.district_id % 3 <> 0 THEN c.district_id END, a.district_id) AS district_id
  FROM r_disp d LEFT JOIN r_client c USING (client_id) LEFT JOIN r_account a ON a.account_id = d.account_id""")
put("project_reorder", 'SELECT "A3", "A1" AS district_id, "A2", 0 AS "A16" FROM r_district')
DISTRICT_ZERO = """coalesce(try_cast("A1" AS DOUBLE), 0) AS "A1", coalesce("A2", '0') AS "A2",
  coalesce("A3", '0') AS "A3", """ + ", ".join(f'0::DOUBLE AS "A{i}"' for i in range(4, 11)) + """,
  coalesce(try_cast("A11" AS DOUBLE), 0) AS "A11", coalesce(try_cast("A12" AS DOUBLE), 0) AS "A12",
  0::DOUBLE AS "A13", 0::DOUBLE AS "A14", coalesce(try_cast("A15" AS DOUBLE), 0) AS "A15", 0::DOUBLE AS "A16" """
put("sentinel_to_zero", f'SELECT "A1" AS key, {DISTRICT_ZERO} FROM r_district')

BIRTH = """s_birth AS (
  SELECT client_id, birth_number, district_id,
    CASE WHEN length(birth_number) >= 6 THEN try_cast(printf('%04d-%02d-%02d',
      y + CASE WHEN y < 50 THEN 2000 ELSE 1900 END, CASE WHEN m > 12 THEN m - 50 ELSE m END, d) AS DATE) END AS born
  FROM (SELECT *, try_cast(substr(birth_number, 1, 2) AS INT) AS y,
          try_cast(substr(birth_number, 3, 2) AS INT) AS m,
          try_cast(substr(birth_number, 5, 2) AS INT) AS d FROM r_client)),
s_age AS (SELECT *, floor((DATE '1999-12-31' - born) / 365.0)::INT AS age FROM s_birth)"""
put("birth_age", "SELECT client_id, born::VARCHAR AS born, age FROM s_age", BIRTH)

FLAGS = """
  (coalesce(loan_purpose, '') IN ('debt_consolidation', 'medical', 'vacation', 'wedding', 'other', 'moving'))::INT AS personal_loan,
  (coalesce(loan_purpose, '') = 'car')::INT AS car_loan,
  (coalesce(loan_purpose, '') IN ('home_improvement', 'house', 'major_purchase', 'home'))::INT AS home_loan,
  (coalesce(loan_purpose, '') = 'credit_card')::INT AS credit_card_loan,
  (coalesce(loan_purpose, '') IN ('small_business', 'business', 'renewable_energy'))::INT AS business_loan"""
put("purpose_flags", f"SELECT loan_id, loan_purpose, {FLAGS} FROM r_loan")
put("purpose_priority", """SELECT loan_id, CASE WHEN loan_purpose = 'car' THEN 'car'
  WHEN loan_purpose IN ('home_improvement', 'major_purchase') THEN 'home'
  WHEN loan_purpose = 'small_business' THEN 'business'
  WHEN loan_purpose IN ('debt_consolidation', 'medical') THEN 'personal' ELSE '' END AS main_purpose
  FROM r_loan""")
put("owner_only", "SELECT DISTINCT client_id, account_id FROM r_disp WHERE type = 'OWNER'")
put("numeric_columns", f"SELECT loan_id, account_id, date_int, duration, {rnd('amount payments')} FROM r_loan")
put("table_preview", """SELECT loan_id, status FROM r_loan
  ORDER BY substr(md5(loan_id::VARCHAR), 1, 13), loan_id LIMIT 5""")
put("district_join", 'SELECT c.client_id, c.district_id, d.* FROM r_client c LEFT JOIN r_district d ON c.district_id = d."A1"')
put("client_accounts", """SELECT client_id, string_agg(account_id::VARCHAR, ',' ORDER BY account_id) AS account_ids
  FROM (SELECT DISTINCT client_id, account_id FROM r_disp WHERE type = 'OWNER') GROUP BY client_id""")

# --- account summaries -------------------------------------------------------------


def flows(k: str = "") -> str:
    """Transaction measures per account; ``k`` scales money."""
    a, b = f"amount{k}", f"balance{k}"
    i, o = "FILTER (WHERE type = 'PRIJEM')", "FILTER (WHERE type = 'VYDAJ')"
    return f"""SELECT account_id, count(trans_id) AS total_transactions, count(*) {i} AS num_incoming,
    count(*) {o} AS num_outgoing, coalesce(sum({a}) {i}, 0) AS total_incoming,
    coalesce(sum({a}) {o}, 0) AS total_outgoing, avg({a}) {i} AS avg_incoming, avg({a}) {o} AS avg_outgoing,
    median({a}) {i} AS median_incoming, median({a}) {o} AS median_outgoing,
    stddev_samp({a}) {i} AS std_incoming, stddev_samp({a}) {o} AS std_outgoing,
    max({a}) {i} AS max_incoming, max({a}) {o} AS max_outgoing, min({a}) {i} AS min_incoming,
    min({a}) {o} AS min_outgoing, min({b}) AS balance_min, max({b}) AS balance_max,
    avg({b}) AS balance_mean, median({b}) AS balance_median, stddev_samp({b}) AS balance_std,
    count(DISTINCT k_symbol) AS unique_k_symbols, count(DISTINCT operation) AS unique_operations,
    count(DISTINCT bank) AS unique_banks, max(date) - min(date) AS transaction_span_days,
    min(date) AS first_transaction_date, max(date) AS last_transaction_date
  FROM r_trans GROUP BY account_id"""


RATIOS = """total_incoming - total_outgoing AS net_cashflow,
    total_incoming / nullif(total_outgoing + 1, 0) AS incoming_outgoing_ratio,
    (total_incoming + total_outgoing) / total_transactions AS avg_transaction_amount,
    total_transactions / nullif(transaction_span_days + 1, 0) AS transaction_frequency,
    balance_std / nullif(balance_mean + 1, 0) AS balance_volatility,
    std_incoming / nullif(avg_incoming + 1, 0) AS incoming_volatility,
    std_outgoing / nullif(avg_outgoing + 1, 0) AS outgoing_volatility,
    max_incoming / nullif(avg_incoming + 1, 0) AS max_to_avg_incoming_ratio,
    max_outgoing / nullif(avg_outgoing + 1, 0) AS max_to_avg_outgoing_ratio"""

BASIC_R = "total_incoming total_outgoing avg_incoming avg_outgoing balance_min balance_max balance_mean"
BASIC_N = "total_transactions, num_incoming, num_outgoing, unique_k_symbols, transaction_span_days"
put("trans_basic", f"SELECT account_id, {BASIC_N}, {rnd(BASIC_R)} FROM ({flows()})")
put("trans_enhanced", f"""SELECT account_id, {BASIC_N}, unique_operations, unique_banks, {rnd(BASIC_R)},
  {rnd('median_incoming median_outgoing std_incoming std_outgoing max_incoming max_outgoing min_incoming min_outgoing balance_std')},
  {rnd('balance_median', 8)}, {text('first_transaction_date last_transaction_date')} FROM ({flows()})""")
put("trans_derived", f"""SELECT account_id, {rnd('net_cashflow incoming_outgoing_ratio avg_transaction_amount transaction_frequency balance_volatility incoming_volatility outgoing_volatility max_to_avg_incoming_ratio max_to_avg_outgoing_ratio')}
  FROM (SELECT account_id, {RATIOS} FROM ({flows()}))""")


def loans(k: str = "", s: str = "") -> str:
    return f"""SELECT account_id, count(loan_id) AS num_loans, sum(amount{k}) AS loan_amount_total{s},
    avg(amount{k}) AS loan_amount_avg{s}, max(amount{k}) AS loan_amount_max{s}, min(amount{k}) AS loan_amount_min{s},
    avg(duration) AS loan_duration_avg, max(duration) AS loan_duration_max, min(duration) AS loan_duration_min,
    avg(payments{k}) AS loan_payment_avg{s}, max(payments{k}) AS loan_payment_max{s}, min(payments{k}) AS loan_payment_min{s},
    {distinct_list('status')} AS loan_status_all, min(date) AS first_loan_date, max(date) AS last_loan_date
  FROM r_loan GROUP BY account_id"""


def orders(k: str = "", s: str = "") -> str:
    return f"""SELECT account_id, count(order_id) AS num_orders, avg(amount{k}) AS avg_order_amount{s},
    sum(amount{k}) AS total_order_amount{s}, max(amount{k}) AS max_order_amount{s},
    min(amount{k}) AS min_order_amount{s}, stddev_samp(amount{k}) AS std_order_amount{s},
    count(DISTINCT bank_to) AS unique_banks_orders, count(DISTINCT k_symbol) AS unique_k_symbols_orders
  FROM r_order GROUP BY account_id"""


CARDS = """SELECT d.client_id, count(card_id) AS num_cards, min(issued) AS earliest_card_issue,
    max(issued) AS latest_card_issue, count(*) FILTER (WHERE c.type = 'classic') AS num_classic_cards,
    count(*) FILTER (WHERE c.type = 'junior') AS num_junior_cards,
    count(*) FILTER (WHERE c.type = 'gold') AS num_gold_cards
  FROM r_card c LEFT JOIN r_disp d USING (disp_id) GROUP BY d.client_id"""

put("loan_summary", f"""SELECT account_id, num_loans, {rnd('loan_amount_total loan_amount_avg loan_amount_max loan_amount_min loan_duration_avg loan_payment_avg loan_payment_max loan_payment_min')},
  loan_duration_max, loan_duration_min, loan_status_all, {text('first_loan_date last_loan_date')} FROM ({loans()})""")
put("order_summary", f"""SELECT account_id, num_orders, {rnd('avg_order_amount total_order_amount max_order_amount min_order_amount std_order_amount')},
  unique_banks_orders, unique_k_symbols_orders FROM ({orders()})""")
put("card_summary", f"SELECT client_id, num_cards, num_classic_cards, num_junior_cards, num_gold_cards, {text('earliest_card_issue latest_card_issue')} FROM ({CARDS})")
put("trans_agg_last", """SELECT account_id, round(sum(amount) + 3.1415926535e-6, 4) AS total_amount, round(avg(amount) + 3.1415926535e-6, 4) AS avg_amount,
  count(amount) AS txn_count, round(last(balance ORDER BY date, trans_id) + 3.1415926535e-6, 4) AS last_balance
  FROM r_trans GROUP BY account_id""")
# Cards of unknown dispositions keep their null keys in one group.
CARD_LABELS = """SELECT d.client_id, d.account_id, c.disp_id, max((lower(c.type) = 'classic')::INT) AS classic,
  max(({gold} = 'gold')::INT) AS gold, max((lower(c.type) = 'junior')::INT) AS junior
  FROM r_card c LEFT JOIN r_disp d ON d.disp_id = c.disp_id GROUP BY d.client_id, d.account_id, c.disp_id"""
put("card_labels", CARD_LABELS.format(gold="lower(c.type)"))
put("csv_sink", CARD_LABELS.format(gold="c.type"))
put("json_encode", CARD_LABELS.format(gold="c.type"))
LOAN_LABELS = f"""s_labels AS (SELECT d.client_id, l.account_id, d.disp_id, l.loan_purpose, {FLAGS}
  FROM r_loan l LEFT JOIN (SELECT * FROM r_disp WHERE type = 'OWNER') d ON d.account_id = l.account_id)"""
put("loan_labels", "SELECT * FROM s_labels", LOAN_LABELS)
put("loan_label_totals", "SELECT " + ", ".join(
    f"sum({c})::BIGINT AS {c}" for c in "personal_loan car_loan home_loan credit_card_loan business_loan".split()
) + " FROM s_labels", LOAN_LABELS)
put("value_counts", "SELECT k_symbol, count(*) AS n FROM r_trans GROUP BY k_symbol")
put("null_profile", """SELECT 'k_symbol' AS column_name, count(*) AS null_count FROM r_trans
  WHERE k_symbol IS NULL HAVING count(*) > 0""")


def described(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS cnt, round(avg({c}) + 3.1415926535e-6, 4) AS mean,
    round(stddev_samp({c}) + 3.1415926535e-6, 4) AS std, round(min({c}), 8) AS min, round(max({c}), 8) AS max,
    round(quantile_cont({c}, 0.25), 8) AS q25, round(quantile_cont({c}, 0.5), 8) AS q50,
    round(quantile_cont({c}, 0.75), 8) AS q75 FROM r_trans"""


put("describe_numeric", described("amount") + " UNION ALL " + described("balance"))

# --- client features, batch --------------------------------------------------------

SUMS = ("total_transactions num_incoming num_outgoing total_incoming total_outgoing unique_k_symbols "
        "unique_operations unique_banks net_cashflow num_loans loan_amount_total{s} num_orders "
        "total_order_amount{s} unique_banks_orders unique_k_symbols_orders")
MEANS = ("avg_incoming avg_outgoing median_incoming median_outgoing std_incoming std_outgoing balance_mean "
         "balance_median balance_std incoming_outgoing_ratio avg_transaction_amount transaction_frequency "
         "balance_volatility incoming_volatility outgoing_volatility max_to_avg_incoming_ratio "
         "max_to_avg_outgoing_ratio loan_amount_avg{s} loan_duration_avg loan_payment_avg{s} "
         "avg_order_amount{s} std_order_amount{s}")
MAXES = ("max_incoming max_outgoing balance_max transaction_span_days loan_amount_max{s} loan_duration_max "
         "loan_payment_max{s} max_order_amount{s}")
MINS = "min_incoming min_outgoing balance_min loan_amount_min{s} loan_duration_min loan_payment_min{s} min_order_amount{s}"
COUNTS = ("total_transactions num_incoming num_outgoing unique_k_symbols unique_operations unique_banks num_loans "
          "num_orders unique_banks_orders unique_k_symbols_orders transaction_span_days loan_duration_max "
          "loan_duration_min").split()
FINE = {
    "": "balance_min balance_max".split(),
    "_usd": ("total_incoming total_outgoing net_cashflow max_incoming max_outgoing min_incoming min_outgoing "
             "balance_min balance_max loan_amount_total_usd "
             "loan_amount_max_usd loan_amount_min_usd total_order_amount_usd max_order_amount_usd "
             "min_order_amount_usd").split(),
}
DATES = "first_transaction_date last_transaction_date first_loan_date last_loan_date"


def rolled(rows: str, s: str, extra: str = "") -> str:
    parts = [f"coalesce(sum({c}), 0) AS {c}" for c in SUMS.format(s=s).split()]
    for fn, names in (("avg", MEANS), ("max", MAXES), ("min", MINS)):
        parts += [f"{fn}({c}) AS {c}" for c in names.format(s=s).split()]
    return f"""SELECT client_id, count(DISTINCT account_id) AS num_accounts, {', '.join(parts)},
    {distinct_list('loan_status_all')} AS loan_status_all, {distinct_list('frequency')} AS frequency,
    min(first_transaction_date) AS first_transaction_date, max(last_transaction_date) AS last_transaction_date,
    min(first_loan_date) AS first_loan_date, max(last_loan_date) AS last_loan_date {extra}
  FROM ({rows}) GROUP BY client_id"""


def shown(s: str, fill: bool = False) -> str:
    """Rounded output columns of the roll-up, read from ``f``."""
    out = []
    for c in " ".join((SUMS, MEANS, MAXES, MINS)).format(s=s).split():
        v = f"f.{c}::BIGINT" if c in COUNTS else f"round(f.{c}, 8)" if c in FINE[s] else f"round(f.{c} + {NUDGE}, 4)"
        out.append(f"{'coalesce(' + v + ', 0)' if fill else v} AS {c}")
    n = "coalesce(f.num_accounts, 0)" if fill else "f.num_accounts"
    return f"{n} AS num_accounts, {', '.join(out)}, f.loan_status_all, f.frequency, {text(DATES, 'f')}"


def batch_ctes(s: str = "", k: str = "", join: str = "LEFT") -> str:
    return f"""s_flow AS ({flows(k)}), s_trans AS (SELECT *, {RATIOS} FROM s_flow),
  s_loan AS ({loans(k, s)}), s_order AS ({orders(k, s)}), s_card AS ({CARDS}),
  s_account AS (SELECT a.account_id, a.frequency, t.* EXCLUDE (account_id), l.* EXCLUDE (account_id),
      o.* EXCLUDE (account_id)
    FROM r_account a {join} JOIN s_trans t ON t.account_id = a.account_id
    LEFT JOIN s_loan l ON l.account_id = a.account_id LEFT JOIN s_order o ON o.account_id = a.account_id)"""


CARD_SHOWN = "k.num_cards, k.num_classic_cards, k.num_junior_cards, k.num_gold_cards, " + text(
    "earliest_card_issue latest_card_issue", "k")
CARD_FILLED = ", ".join(f"coalesce(k.{c}, 0) AS {c}" for c in
    "num_cards num_classic_cards num_junior_cards num_gold_cards".split()) + ", " + text(
    "earliest_card_issue latest_card_issue", "k")

for name, fill in (("client_features_batch", False), ("client_features_filled", True)):
    owned = """SELECT d.client_id, d.account_id, a.* EXCLUDE (account_id) FROM r_disp d
      LEFT JOIN s_account a ON a.account_id = d.account_id WHERE d.type = 'OWNER'"""
    put(name, f"""SELECT c.client_id, c.birth_number, c.district_id, {shown('', fill)},
      {CARD_FILLED if fill else CARD_SHOWN}, d.*
    FROM r_client c JOIN s_features f ON f.client_id = c.client_id
    LEFT JOIN s_card k ON k.client_id = c.client_id LEFT JOIN r_district d ON d."A1" = c.district_id""",
        batch_ctes(join="INNER") + f", s_features AS ({rolled(owned, '')})")

ID_ROWS = """SELECT d.client_id, d.account_id, a.* EXCLUDE (account_id),
    (SELECT 1) AS one, ti.trans_id, li.loan_id, oi.order_id
  FROM r_disp d LEFT JOIN s_account a ON a.account_id = d.account_id
  LEFT JOIN (SELECT account_id, min(trans_id) AS trans_id FROM r_trans GROUP BY 1) ti ON ti.account_id = d.account_id
  LEFT JOIN (SELECT account_id, min(loan_id) AS loan_id FROM r_loan GROUP BY 1) li ON li.account_id = d.account_id
  LEFT JOIN (SELECT account_id, min(order_id) AS order_id FROM r_order GROUP BY 1) oi ON oi.account_id = d.account_id"""
ID_LISTS = ", " + ", ".join(f"{distinct_list(c)} AS {c}_list" for c in "account_id loan_id order_id trans_id".split())
CARD_IDS = f"""s_card_ids AS (SELECT d.client_id, {distinct_list('card_id')} AS card_id
  FROM r_card c JOIN r_disp d ON d.disp_id = c.disp_id GROUP BY d.client_id)"""
ID_SHOWN = ("f.account_id_list AS account_id, f.loan_id_list AS loan_id, f.order_id_list AS order_id, "
            "f.trans_id_list AS trans_id, CASE WHEN f.client_id IS NOT NULL THEN coalesce(ci.card_id, '') END AS card_id")


def with_ids(s: str, k: str, cards: bool) -> tuple[str, str]:
    body = f"""SELECT c.client_id, c.birth_number, c.district_id, {shown(s)}, {ID_SHOWN},
      {CARD_SHOWN + ',' if cards else ''} d.*
    FROM r_client c LEFT JOIN s_features f ON f.client_id = c.client_id
    LEFT JOIN s_card_ids ci ON ci.client_id = c.client_id
    LEFT JOIN s_card k ON k.client_id = c.client_id LEFT JOIN r_district d ON d."A1" = c.district_id"""
    ctes = batch_ctes(s, k) + f", {CARD_IDS}, s_features AS ({rolled(ID_ROWS, s, ID_LISTS)})"
    return body, ctes


put("client_features_ids", *with_ids("", "", False))
put("client_features_cards", *with_ids("", "", True))
put("client_features_usd", *with_ids("_usd", " * 0.038::DOUBLE", True))
put("client_ids", f"""SELECT c.client_id, {ID_SHOWN} FROM r_client c LEFT JOIN s_features f ON f.client_id = c.client_id
  LEFT JOIN s_card_ids ci ON ci.client_id = c.client_id""", with_ids("", "", False)[1])
put("client_id_rows", """SELECT DISTINCT client_id, 'account_id' AS id_kind, account_id::VARCHAR AS id FROM r_disp
  UNION ALL SELECT DISTINCT client_id, 'trans_id', m FROM r_disp
    JOIN (SELECT account_id, min(trans_id) AS m FROM r_trans GROUP BY 1) USING (account_id)
  UNION ALL SELECT DISTINCT client_id, 'loan_id', m::VARCHAR FROM r_disp
    JOIN (SELECT account_id, min(loan_id) AS m FROM r_loan GROUP BY 1) USING (account_id)
  UNION ALL SELECT DISTINCT client_id, 'order_id', m FROM r_disp
    JOIN (SELECT account_id, min(order_id) AS m FROM r_order GROUP BY 1) USING (account_id)
  UNION ALL SELECT DISTINCT d.client_id, 'card_id', card_id FROM r_card c LEFT JOIN r_disp d USING (disp_id)""")

put("client_features_v1", """SELECT DISTINCT c.client_id, c.birth_number, c.district_id, d."A2", d."A3", d."A11",
    f.num_accounts, round(f.total_balance_mean + 3.1415926535e-6, 4) AS total_balance_mean,
    round(f.total_incoming_sum + 3.1415926535e-6, 4) AS total_incoming_sum, round(f.total_outgoing_sum + 3.1415926535e-6, 4) AS total_outgoing_sum,
    round(f.loan_amount_total + 3.1415926535e-6, 4) AS loan_amount_total, f.loan_status_all, f.num_orders::BIGINT AS num_orders,
    k.num_cards, k.earliest_card_issue::VARCHAR AS earliest_card_issue
  FROM r_client c LEFT JOIN s_v1 f ON f.client_id = c.client_id LEFT JOIN s_card k ON k.client_id = c.client_id
  LEFT JOIN r_district d ON d."A1" = c.district_id""",
    batch_ctes() + f""", s_v1 AS (SELECT d.client_id, count(DISTINCT d.account_id) AS num_accounts,
    avg(a.balance_mean) AS total_balance_mean, coalesce(sum(a.total_incoming), 0) AS total_incoming_sum,
    coalesce(sum(a.total_outgoing), 0) AS total_outgoing_sum, coalesce(sum(a.loan_amount_total), 0) AS loan_amount_total,
    {distinct_list('a.loan_status_all')} AS loan_status_all, coalesce(sum(a.num_orders), 0) AS num_orders
  FROM r_disp d LEFT JOIN s_account a ON a.account_id = d.account_id WHERE d.type = 'OWNER' GROUP BY d.client_id)""")

put("client_360", """SELECT c.client_id, c.birth_number, c.district_id, d."A2", d."A3", d."A11",
    (SELECT count(*) FROM s_mine) AS num_accounts,
    round((SELECT avg(balance_mean) FROM s_mine) + 3.1415926535e-6, 4) AS total_balance_mean,
    round((SELECT coalesce(sum(total_incoming), 0) FROM s_mine) + 3.1415926535e-6, 4) AS total_incoming_sum,
    round((SELECT coalesce(sum(total_outgoing), 0) FROM s_mine) + 3.1415926535e-6, 4) AS total_outgoing_sum,
    round((SELECT coalesce(sum(loan_amount_total), 0) FROM s_mine) + 3.1415926535e-6, 4) AS loan_amount_total,
    (SELECT count(*) FROM r_card WHERE disp_id IN (SELECT disp_id FROM r_disp WHERE client_id = 5 AND type = 'OWNER')) AS num_cards,
    (SELECT count(*) FROM r_order WHERE account_id IN (SELECT account_id FROM s_mine)) AS num_orders
  FROM r_client c LEFT JOIN r_district d ON d."A1" = c.district_id WHERE c.client_id = 5""",
    batch_ctes() + """, s_mine AS (SELECT * FROM s_account WHERE account_id IN
    (SELECT account_id FROM r_disp WHERE client_id = 5 AND type = 'OWNER'))""")

# --- client features, realtime -----------------------------------------------------

K = "0.038::DOUBLE"


def pooled(kind: str, tag: str) -> str:
    f = f"FILTER (WHERE type = '{kind}')"
    a = f"amount * {K}"
    return f"""count(*) {f} AS num_{tag}, coalesce(sum({a}) {f}, 0) AS total_{tag}, coalesce(avg({a}) {f}, 0) AS avg_{tag},
    coalesce(median({a}) {f}, 0) AS median_{tag}, coalesce(stddev_pop({a}) {f}, 0) AS std_{tag},
    coalesce(max({a}) {f}, 0) AS max_{tag}, coalesce(min({a}) {f}, 0) AS min_{tag}"""


RT_CTES = f"""{LOAN_LABELS},
s_links AS (SELECT d.client_id, d.account_id, a.frequency FROM r_disp d JOIN r_account a ON a.account_id = d.account_id),
x_acc AS (SELECT client_id, count(*) AS num_accounts, arg_min(frequency, account_id) AS frequency,
    min(account_id)::VARCHAR AS account_id FROM s_links GROUP BY client_id),
x_tr AS (SELECT client_id, count(*) AS total_transactions, {pooled('PRIJEM', 'incoming')}, {pooled('VYDAJ', 'outgoing')},
    min(balance * {K}) AS balance_min, max(balance * {K}) AS balance_max, avg(balance * {K}) AS balance_mean,
    median(balance * {K}) AS balance_median, stddev_pop(balance * {K}) AS balance_std,
    count(DISTINCT nullif(k_symbol, '')) AS unique_k_symbols, count(DISTINCT nullif(operation, '')) AS unique_operations,
    count(DISTINCT nullif(bank, '')) AS unique_banks, min(date_int) AS d0, max(date_int) AS d1,
    avg(amount * {K}) AS avg_transaction_amount, min(trans_id) AS trans_id
  FROM r_trans t JOIN s_links l ON l.account_id = t.account_id GROUP BY client_id),
x_ln AS (SELECT client_id, count(*) AS num_loans, sum(amount * {K}) AS loan_amount_total_usd,
    avg(amount * {K}) AS loan_amount_avg_usd, max(amount * {K}) AS loan_amount_max_usd, min(amount * {K}) AS loan_amount_min_usd,
    avg(duration) AS loan_duration_avg, max(duration) AS loan_duration_max, min(duration) AS loan_duration_min,
    avg(payments * {K}) AS loan_payment_avg_usd, max(payments * {K}) AS loan_payment_max_usd,
    min(payments * {K}) AS loan_payment_min_usd, {distinct_list('status')} AS loan_status_all,
    min(date_int)::VARCHAR AS first_loan_date, max(date_int)::VARCHAR AS last_loan_date, min(loan_id)::VARCHAR AS loan_id
  FROM r_loan t JOIN s_links l ON l.account_id = t.account_id GROUP BY client_id),
x_lb AS (SELECT client_id, arg_max(car_loan, disp_id) AS car_loan, arg_max(personal_loan, disp_id) AS personal_loan,
    arg_max(home_loan, disp_id) AS home_loan, arg_max(business_loan, disp_id) AS business_loan
  FROM s_labels WHERE client_id IS NOT NULL GROUP BY client_id),
x_or AS (SELECT client_id, count(*) AS num_orders, avg(amount * {K}) AS avg_order_amount_usd,
    sum(amount * {K}) AS total_order_amount_usd, max(amount * {K}) AS max_order_amount_usd,
    min(amount * {K}) AS min_order_amount_usd, stddev_pop(amount * {K}) AS std_order_amount_usd,
    count(DISTINCT nullif(bank_to, '')) AS unique_banks_orders, count(DISTINCT nullif(k_symbol, '')) AS unique_k_symbols_orders,
    min(order_id) AS order_id
  FROM r_order t JOIN s_links l ON l.account_id = t.account_id GROUP BY client_id),
x_cd AS (SELECT d.client_id, count(*) AS num_cards, count(*) FILTER (WHERE lower(c.type) = 'classic') AS num_classic_cards,
    count(*) FILTER (WHERE lower(c.type) = 'junior') AS num_junior_cards, count(*) FILTER (WHERE lower(c.type) = 'gold') AS num_gold_cards,
    min(issued)::VARCHAR AS earliest_card_issue, max(issued)::VARCHAR AS latest_card_issue, min(card_id) AS card_id
  FROM r_card c JOIN r_disp d ON d.disp_id = c.disp_id GROUP BY d.client_id),
x_di AS (SELECT "A1" AS dkey, {DISTRICT_ZERO} FROM r_district)"""

RT_R4 = ("avg_incoming avg_outgoing std_incoming std_outgoing balance_mean balance_std avg_transaction_amount "
         "loan_amount_avg_usd loan_duration_avg loan_payment_avg_usd loan_payment_max_usd loan_payment_min_usd "
         "avg_order_amount_usd std_order_amount_usd").split()
RT_R8 = [c for c in FINE["_usd"] if c != "net_cashflow"] + ["median_incoming", "median_outgoing", "balance_median"]
RT_INT = ("num_accounts total_transactions num_incoming num_outgoing unique_k_symbols unique_operations unique_banks "
          "num_loans loan_duration_max loan_duration_min num_orders unique_banks_orders unique_k_symbols_orders num_cards "
          "num_classic_cards num_junior_cards num_gold_cards").split()
RT_TEXT = ("frequency trans_id loan_status_all first_loan_date last_loan_date loan_id order_id earliest_card_issue "
           "latest_card_issue card_id").split()
RT_LIST = ", ".join(
    [f"round(coalesce({c}, 0) + 3.1415926535e-6, 4) AS {c}" for c in RT_R4]
    + [f"round(coalesce({c}, 0), 8) AS {c}" for c in RT_R8]
    + [f"coalesce({c}, 0) AS {c}" for c in RT_INT]
    + [f"coalesce({c}, '') AS {c}" for c in RT_TEXT]
)
PURPOSE_ON = {f: f"CASE WHEN num_loans > 0 THEN coalesce({f}, 0) ELSE 0 END" for f in
              ("car_loan", "personal_loan", "home_loan", "business_loan")}
put("client_features_rt", f"""SELECT c.client_id, c.birth_number, c.district_id, {RT_LIST},
    CASE WHEN total_transactions > 0 THEN x_acc.account_id ELSE '' END AS account_id,
    coalesce(d0::VARCHAR, '') AS first_transaction_date, coalesce(d1::VARCHAR, '') AS last_transaction_date,
    coalesce(d1 - d0, 0) AS transaction_span_days,
    round(coalesce(total_incoming - total_outgoing, 0), 8) AS net_cashflow,
    round(CASE WHEN total_outgoing > 0 THEN total_incoming / total_outgoing ELSE 0 END + 3.1415926535e-6, 4) AS incoming_outgoing_ratio,
    round(coalesce(total_transactions / greatest(d1 - d0, 1), 0) + 3.1415926535e-6, 4) AS transaction_frequency,
    round(coalesce(balance_std, 0) + 3.1415926535e-6, 4) AS balance_volatility, round(coalesce(std_incoming, 0) + 3.1415926535e-6, 4) AS incoming_volatility,
    round(coalesce(std_outgoing, 0) + 3.1415926535e-6, 4) AS outgoing_volatility,
    round(CASE WHEN avg_incoming > 0 THEN max_incoming / avg_incoming ELSE 0 END + 3.1415926535e-6, 4) AS max_to_avg_incoming_ratio,
    round(CASE WHEN avg_outgoing > 0 THEN max_outgoing / avg_outgoing ELSE 0 END + 3.1415926535e-6, 4) AS max_to_avg_outgoing_ratio,
    {', '.join(f'{v} AS {k}' for k, v in PURPOSE_ON.items())},
    CASE WHEN {PURPOSE_ON['car_loan']} = 1 THEN 'car' WHEN {PURPOSE_ON['home_loan']} = 1 THEN 'home'
      WHEN {PURPOSE_ON['business_loan']} = 1 THEN 'business' WHEN {PURPOSE_ON['personal_loan']} = 1 THEN 'personal'
      ELSE '' END AS loan_purpose,
    (coalesce(num_gold_cards, 0) > 0)::INT AS gold_card, (coalesce(num_classic_cards, 0) > 0)::INT AS classic_card,
    (coalesce(num_junior_cards, 0) > 0)::INT AS junior_card, x_di.* EXCLUDE (dkey)
  FROM r_client c LEFT JOIN x_acc ON x_acc.client_id = c.client_id LEFT JOIN x_tr ON x_tr.client_id = c.client_id
  LEFT JOIN x_ln ON x_ln.client_id = c.client_id LEFT JOIN x_lb ON x_lb.client_id = c.client_id
  LEFT JOIN x_or ON x_or.client_id = c.client_id LEFT JOIN x_cd ON x_cd.client_id = c.client_id
  LEFT JOIN x_di ON x_di.dkey = c.district_id""", RT_CTES)

# A store that follows changes ends where a batch over the changed tables ends.
ORACLE["store_follow"] = ORACLE["client_features_rt"]
ORACLE["store_moved_disposition"] = ORACLE["client_features_rt"].replace(
    "o_orderkey AS disp_id, o_custkey AS client_id,",
    """o_orderkey AS disp_id, CASE WHEN o_orderpriority IS DISTINCT FROM '5-LOW' THEN o_custkey
      WHEN o_custkey % 2 = 1 THEN o_custkey + 1 ELSE o_custkey - 1 END AS client_id,""",
    1,
)

# --- splits ------------------------------------------------------------------------

put("chrono_split", """SELECT trans_id, account_id, date::VARCHAR AS date, rn <= floor(n * 0.5::DOUBLE) AS present
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, substr(md5(trans_id), 1, 13), trans_id) AS rn,
          count(*) OVER (PARTITION BY account_id) AS n FROM r_trans)""")


def sampled(source: str, key: str, fraction: str, seed: int, name: str) -> str:
    return f"""SELECT * EXCLUDE (rn, n), rn <= floor(n * {fraction}::DOUBLE) AS {name}
  FROM (SELECT *, row_number() OVER (ORDER BY substr(md5('{seed}|' || {key}::VARCHAR), 1, 13),
      substr(md5({key}::VARCHAR), 1, 13), {key}) AS rn, count(*) OVER () AS n FROM {source})"""


put("sample_fraction", sampled("(SELECT client_id FROM r_client)", "client_id", "0.3", 42, "selected"))
put("entity_split", sampled("(SELECT client_id FROM r_client)", "client_id", "0.85", 42, "present"))
put("dedupe_latest", """SELECT client_id, seq, type, round(amount + 3.1415926535e-6, 4) AS amount FROM r_stream
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC) = 1""")
put("first_row_per_account", """SELECT account_id, trans_id, round(amount + 3.1415926535e-6, 4) AS amount FROM r_trans
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY trans_id) = 1""")

SPLIT = f"""s_split AS ({sampled('(SELECT client_id FROM r_client)', 'client_id', '0.85', 42, 'present')}),
pc AS (SELECT client_id FROM s_split WHERE present),
pa AS (SELECT DISTINCT account_id FROM r_disp WHERE type = 'OWNER' AND client_id IN (SELECT client_id FROM pc)),
pd AS (SELECT disp_id FROM r_disp WHERE account_id IN (SELECT account_id FROM pa)),
pt AS (SELECT trans_id, account_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id
      ORDER BY date, substr(md5(trans_id), 1, 13), trans_id) AS rn, count(*) OVER (PARTITION BY account_id) AS n
    FROM r_trans WHERE account_id IN (SELECT account_id FROM pa)) WHERE rn <= floor(n * 0.5::DOUBLE)),
{LOAN_LABELS}"""


def halves(table: str, source: str, key: str, ids: str) -> str:
    inside = f"coalesce({key} IN (SELECT {key} FROM {ids}), false)"
    return f"""SELECT '{table}' AS table_name, 'present' AS half, count(*) FILTER (WHERE {inside}) AS n FROM {source}
  UNION ALL SELECT '{table}', 'stream', count(*) FILTER (WHERE NOT {inside}) FROM {source}"""


put("split_tables", "\n  UNION ALL ".join([
    halves("client", "r_client", "client_id", "pc"), halves("account", "r_account", "account_id", "pa"),
    halves("disp", "r_disp", "account_id", "pa"), halves("loan", "r_loan", "account_id", "pa"),
    halves("order", "r_order", "account_id", "pa"), halves("card", "r_card", "disp_id", "pd"),
    halves("trans", "r_trans", "trans_id", "pt"), halves("loan_labels", "s_labels", "client_id", "pc"),
    "SELECT 'district', 'present', count(*) FROM r_district", "SELECT 'district', 'stream', count(*) FROM r_district",
]), SPLIT)


def routed(table: str, source: str, key: str, ids: str, *shown: str) -> str:
    inside = f"coalesce({key} IN (SELECT {key} FROM {ids}), false)"
    return f"""SELECT '{table}' AS table_name, concat_ws('|', {', '.join(shown)}) AS row_key,
    CASE WHEN {inside} THEN 'present' ELSE 'stream' END AS half FROM {source}"""


CARD_LABEL_KEYS = """(SELECT DISTINCT d.client_id, d.account_id, d.disp_id
    FROM r_card c LEFT JOIN r_disp d ON d.disp_id = c.disp_id)"""
put("split_rows", "\n  UNION ALL ".join([
    routed("client", "r_client", "client_id", "pc", "client_id"),
    routed("account", "r_account", "account_id", "pa", "account_id"),
    routed("disp", "r_disp", "account_id", "pa", "disp_id"),
    routed("loan", "r_loan", "account_id", "pa", "loan_id"),
    routed("order", "r_order", "account_id", "pa", "order_id"),
    routed("card", "r_card", "disp_id", "pd", "card_id"),
    routed("trans", "r_trans", "trans_id", "pt", "trans_id"),
    routed("loan_labels", "s_labels", "client_id", "pc", "client_id", "account_id"),
    routed("card_labels", CARD_LABEL_KEYS, "client_id", "pc", "client_id", "account_id", "disp_id"),
    """SELECT 'district', "A1"::VARCHAR, 'present' FROM r_district""",
    """SELECT 'district', "A1"::VARCHAR, 'stream' FROM r_district""",
]), SPLIT)
put("present_transactions", "SELECT trans_id, account_id FROM pt", SPLIT)

SNAPSHOT = """s_agg AS (SELECT account_id, avg(amount) AS amount_mean, sum(amount) AS amount_sum, count(amount) AS amount_count,
    avg(balance) AS balance_mean, max(balance) AS balance_max, min(balance) AS balance_min,
    last(balance ORDER BY date, trans_id) AS balance_last FROM r_trans GROUP BY account_id),
s_rows_d AS (SELECT d.disp_id, d.client_id, d.account_id, c.birth_number, a.frequency,
    coalesce(c.district_id, a.district_id) AS district_id, l.loan_id, l.amount AS loan_amount, l.duration, l.payments, l.status,
    g.* EXCLUDE (account_id)
  FROM r_disp d LEFT JOIN r_client c ON c.client_id = d.client_id LEFT JOIN r_account a ON a.account_id = d.account_id
  LEFT JOIN r_loan l ON l.account_id = d.account_id LEFT JOIN s_agg g ON g.account_id = d.account_id),
s_snap AS (SELECT r.*, coalesce(x."A11", 0)::DOUBLE AS district_avg_salary, (r.loan_id IS NOT NULL)::INT AS has_home_loan
  FROM s_rows_d r LEFT JOIN r_district x ON x."A1" = r.district_id
  QUALIFY row_number() OVER (PARTITION BY r.client_id ORDER BY balance_last DESC NULLS LAST, r.account_id, r.disp_id) = 1)"""
put("client_snapshot", f"""SELECT disp_id, client_id, account_id, birth_number, frequency, district_id, loan_id, duration, status,
  amount_count, has_home_loan, {rnd('loan_amount payments amount_mean amount_sum balance_mean balance_max balance_min balance_last district_avg_salary')}
  FROM s_snap""", SNAPSHOT)
POOL = "(SELECT client_id, has_home_loan FROM s_snap WHERE has_home_loan = 0)"
put("train_test_split", f"""SELECT client_id, has_home_loan, 'train' AS part FROM
    ({sampled(POOL, 'client_id', '0.7', 43, 'chosen')}) WHERE chosen
  UNION ALL SELECT client_id, has_home_loan, 'test' FROM
    ({sampled('(SELECT client_id, has_home_loan FROM s_snap)', 'client_id', '0.3', 42, 'chosen')}) WHERE chosen""", SNAPSHOT)

# --- rules -------------------------------------------------------------------------

ENRICH = f"""{SCORING}, {BIRTH},
s_tot AS (SELECT account_id, avg(amount) AS avg_amount, count(amount) AS n, last(balance ORDER BY date, trans_id) AS last_balance
  FROM r_trans GROUP BY account_id),
s_hit AS (SELECT r.trans_id, r.client_id, r.account_id, c.age,
    CASE WHEN c.client_id IS NOT NULL THEN c.district_id ELSE r.district_id END AS district_id,
    coalesce(nullif(r.balance, 0), t.last_balance, 0) AS balance, coalesce(t.n, 0) AS txn_count, t.avg_amount,
    a.frequency AS account_frequency
  FROM s_rows r LEFT JOIN s_age c ON c.client_id = r.client_id AND r.client_id > 0
  LEFT JOIN s_tot t ON t.account_id = r.account_id AND r.account_id <> 0
  LEFT JOIN r_account a ON a.account_id = r.account_id AND r.account_id <> 0),
s_enr AS (SELECT h.*, CASE WHEN balance <> 0 AND txn_count <> 0 THEN balance / greatest(txn_count, 1) ELSE balance END AS avg_balance,
    CASE WHEN coalesce(avg_amount, 0) <> 0 THEN avg_amount * 36 ELSE coalesce(d."A11", 0) END AS income,
    least(txn_count / 100.0::DOUBLE, 1) AS activity_score, txn_count > 10 AS has_employment, balance < 0 AS has_default
  FROM s_hit h LEFT JOIN r_district d ON d."A1" = h.district_id AND h.district_id > 0),
s_score AS (SELECT *, coalesce(age, 0) AS age0,
    round(least(1.0, CASE WHEN balance > 100000 THEN 0.3 WHEN balance > 50000 THEN 0.2 WHEN balance > 20000 THEN 0.1 ELSE 0 END
      + CASE WHEN income > 50000 THEN 0.3 WHEN income > 35000 THEN 0.2 WHEN income > 25000 THEN 0.1 ELSE 0 END
      + activity_score * 0.2::DOUBLE
      + CASE WHEN coalesce(age, 0) BETWEEN 30 AND 50 THEN 0.2 WHEN coalesce(age, 0) BETWEEN 25 AND 60 THEN 0.1 ELSE 0 END), 3) AS score,
    coalesce(age, 0) BETWEEN 25 AND 60 AND balance >= 50000 AND income >= 35000 AS ok,
    concat_ws(', ', CASE WHEN coalesce(age, 0) < 25 THEN 'age < 25' END, CASE WHEN balance < 50000 THEN 'balance < 50000' END,
      CASE WHEN income < 35000 THEN 'income < 35000' END) AS found
  FROM s_enr)"""
put("enrich_txn", f"""SELECT trans_id, client_id, district_id, age, {rnd('balance avg_balance income activity_score')}, txn_count,
  has_employment, has_default, account_frequency FROM s_enr""", ENRICH)
put("eligibility", """SELECT trans_id, ok AS home_loan, ok AND NOT has_default AS no_default,
  age0 <= 50 AND balance >= 20000 AND has_employment AS strict FROM s_score""", ENRICH)
put("ineligible_reasons", """SELECT trans_id, CASE WHEN found = '' THEN 'config rules' ELSE found END AS reasons
  FROM s_score WHERE NOT ok""", ENRICH)
put("rule_score", "SELECT trans_id, round(score + 3.1415926535e-6, 4) AS score, score >= 0.5 AS accepted FROM s_score", ENRICH)


def shown_number(c: str, digits: int) -> str:
    return (f"regexp_replace(round({c}::DECIMAL(28, 6), {digits})::DECIMAL(28, {digits})::VARCHAR, "
            r"'(\.[0-9]+?)0+$', '\1')")


LINE = f"""CASE WHEN ok THEN (CASE WHEN score >= 0.5 THEN 'TARGET' ELSE 'SKIP (low score)' END) || ': Client ' || who
    || ' | Features: {{''age'': ' || coalesce(age::VARCHAR, '''N/A''') || ', ''balance'': ' || {shown_number('balance', 2)}
    || ', ''income'': ' || {shown_number('income', 2)} || ', ''activity_score'': ' || {shown_number('activity_score', 3)}
    || '}} | Predicted(accept): ' || (CASE WHEN score >= 0.5 THEN 'True' ELSE 'False' END) || ' (prob: ' || printf('%.3f', score) || ')'
  ELSE 'SKIP:   Client ' || who || ' | Ineligible under home_loan config ('
    || (CASE WHEN found = '' THEN 'config rules' ELSE found END) || ')' END"""
WHO = "(SELECT *, CASE WHEN client_id > 0 THEN client_id::VARCHAR ELSE 'N/A' END AS who FROM s_score)"
put("decision_line", f"SELECT trans_id, {LINE} AS output FROM {WHO}", ENRICH)
put("stream_score", f"SELECT trans_id AS row_key, {LINE} AS output FROM {WHO}", ENRICH)
# Three batches, each with the totals of what came before it.
RUNNING = ENRICH.replace(
    "s_tot AS (SELECT account_id,", """s_cut AS (SELECT * FROM (VALUES (DATE '1998-06-30', DATE '1999-12-31'),
    (DATE '1999-12-31', DATE '2000-12-31'), (DATE '2000-12-31', DATE '9999-12-31')) v(lo, hi)),
s_tot AS (SELECT lo, hi, account_id,""",
).replace(
    "FROM r_trans GROUP BY account_id)", "FROM r_trans JOIN s_cut ON coalesce(date, DATE '1900-01-01') <= lo GROUP BY lo, hi, account_id)"
).replace(
    "t.account_id = r.account_id AND r.account_id <> 0", "t.account_id = r.account_id AND r.account_id <> 0 AND r.date > t.lo AND r.date <= t.hi"
).replace(
    "a.account_id = r.account_id AND r.account_id <> 0)", "a.account_id = r.account_id AND r.account_id <> 0 WHERE r.date > DATE '1998-06-30')"
)
RUNNING = RUNNING.replace("SELECT t.trans_id, t.account_id,", "SELECT t.trans_id, t.date, t.account_id,", 1)
put("stream_score_running", f"SELECT trans_id, {LINE} AS output FROM {WHO}", RUNNING)

# --- look-alike --------------------------------------------------------------------

VECTOR = f"""{SNAPSHOT}, {BIRTH},
s_vec AS (SELECT s.client_id, s.has_home_loan, coalesce(a.age, (SELECT median(b.age) FROM s_snap t JOIN s_age b USING (client_id)))::DOUBLE AS age,
    coalesce(balance_last, 0) AS balance_last, coalesce(balance_mean, 0) AS balance_mean, coalesce(balance_max, 0) AS balance_max,
    coalesce(balance_min, 0) AS balance_min, coalesce(amount_mean, 0) AS amount_mean, coalesce(amount_sum, 0) AS amount_sum,
    coalesce(amount_count, 0)::DOUBLE AS amount_count, district_avg_salary, coalesce(amount_count, 0)::DOUBLE AS txn_count
  FROM s_snap s LEFT JOIN s_age a ON a.client_id = s.client_id)"""
FEATURES = ("age balance_last balance_mean balance_max balance_min amount_mean amount_sum amount_count "
            "district_avg_salary txn_count").split()
put("feature_vector", f"SELECT client_id, {rnd(' '.join(FEATURES))} FROM s_vec", VECTOR)


def z_scores(source: str, fit: str, keep: str, features=FEATURES) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in features)
    scaled = ", ".join(f"({c} - m_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1 END AS {c}" for c in features)
    return f"SELECT {keep}, {scaled} FROM {source}, (SELECT {stats} FROM {fit})"


BOTH = "(SELECT * FROM s_vec UNION ALL SELECT * FROM s_vec WHERE has_home_loan = 1)"
put("standardize", f"SELECT client_id, {rnd(' '.join(FEATURES))} FROM ({z_scores('s_vec', BOTH, 'client_id')})", VECTOR)

TRAIN = f"""{VECTOR},
s_train AS (SELECT v.* FROM s_vec v JOIN ({sampled(POOL, 'client_id', '0.7', 43, 'chosen')}) c ON c.client_id = v.client_id AND c.chosen),
s_cohort AS (SELECT v.* FROM s_vec v JOIN ({sampled('(SELECT client_id, has_home_loan FROM s_snap)', 'client_id', '0.3', 42, 'chosen')}) c
  ON c.client_id = v.client_id AND c.chosen WHERE v.has_home_loan = 1),
z_train AS ({z_scores('s_train', '(SELECT * FROM s_train UNION ALL SELECT * FROM s_cohort)', 'client_id')}),
z_cohort AS ({z_scores('s_cohort', '(SELECT * FROM s_train UNION ALL SELECT * FROM s_cohort)', 'client_id')}),
l_train AS (SELECT client_id, [{', '.join(FEATURES)}] AS v FROM z_train),
l_cohort AS (SELECT [{', '.join(FEATURES)}] AS v FROM z_cohort),
s_sim AS (SELECT t.client_id, avg(list_cosine_similarity(t.v, c.v)) AS s FROM l_train t, l_cohort c GROUP BY t.client_id)"""
put("lookalike_targets", """SELECT client_id, round(s, 6) AS similarity_score FROM (SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY s DESC, substr(md5(client_id::VARCHAR), 1, 13), client_id) AS rn FROM s_sim)
  WHERE rn <= greatest(100, floor(n * 0.2::DOUBLE))""", TRAIN)

SIM = """s_ranked AS (SELECT e.vec_id, e.label, (e.label = 3)::INT AS y, avg(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS s
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE label = 3) c GROUP BY ALL)"""
put("l2_normalize", """SELECT vec_id, (i - 1)::INT AS position, round(embedding[i]::DOUBLE / n + 3.1415926535e-6, 4) AS component
  FROM (SELECT *, unnest(range(1, 65)) AS i, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
put("rank_similarity", """SELECT vec_id, label, round(s, 6) AS similarity_score, round((s + 1) / 2, 3) AS unit_score
  FROM s_ranked""", SIM)
put("top_targets", """SELECT vec_id, y, round(s, 6) AS similarity_score FROM (SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY s DESC, substr(md5(vec_id::VARCHAR), 1, 13), vec_id) AS rn FROM s_ranked)
  WHERE rn <= greatest(100, floor(n * 0.2::DOUBLE))""", SIM)
put("precision_at_k", """SELECT k, sum(y)::BIGINT AS hits, round(sum(y) / k::DOUBLE + 3.1415926535e-6, 4) AS precision
  FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rn, count(*) OVER () AS n FROM s_ranked),
    (SELECT unnest([10, 20, 50, 100]) AS k) WHERE rn <= k AND k <= n GROUP BY k""", SIM)
put("cohort_eval", """SELECT count(*) AS users, sum(y)::BIGINT AS users_with, sum(1 - y)::BIGINT AS users_without,
    round(avg(s) FILTER (WHERE y = 1) + 3.1415926535e-6, 4) AS mean_with, round(avg(s) FILTER (WHERE y = 0) + 3.1415926535e-6, 4) AS mean_without,
    count(*) FILTER (WHERE up <= 100) AS top_n, (sum(y) FILTER (WHERE up <= 100))::BIGINT AS top_hits,
    count(*) FILTER (WHERE down <= 100) AS bottom_n, (sum(y) FILTER (WHERE down <= 100))::BIGINT AS bottom_hits,
    round(avg(y) FILTER (WHERE up <= 100) * 100 + 3.1415926535e-6, 4) AS top_percent, round(avg(y) FILTER (WHERE down <= 100) * 100 + 3.1415926535e-6, 4) AS bottom_percent,
    (avg(y) FILTER (WHERE up <= 100) > 0.5)::INT AS top_passes, (avg(y) FILTER (WHERE down <= 100) < 0.5)::INT AS bottom_passes
  FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS up, row_number() OVER (ORDER BY s, vec_id DESC) AS down FROM s_ranked)""", SIM)
put("class_means", "SELECT y, count(*) AS n, round(avg(s) + 3.1415926535e-6, 4) AS mean_score FROM s_ranked GROUP BY y", SIM)

# --- nearest neighbour -------------------------------------------------------------

PAIRS = (
    ("balance_mean", "annual_income"), ("total_incoming", "total_credit_utilized"), ("total_outgoing", "loan_amount"),
    ("loan_amount_total_usd", "installment"), ("loan_payment_avg_usd", "term"), ("loan_duration_avg", "num_mort_accounts"),
    ("num_loans", "num_total_cc_accounts"), ("num_cards", "debt_to_income"),
)
Q_COLS, P_COLS = [a for a, _ in PAIRS], [b for _, b in PAIRS]
D2 = " + ".join(f"pow(q.{a} - p.{b}, 2)" for a, b in PAIRS)
KNN = with_ids("_usd", " * 0.038::DOUBLE", True)[1] + f""",
k_ext AS (SELECT o_orderkey AS external_id, c_acctbal * 12 AS annual_income, c_acctbal + o_totalprice AS total_credit_utilized,
    o_totalprice AS loan_amount, o_totalprice / (12 * (1 + o_orderkey % 5)) AS installment, (12 * (1 + o_orderkey % 5))::DOUBLE AS term,
    (o_orderkey % 4)::DOUBLE AS num_mort_accounts, (o_orderkey % 7)::DOUBLE AS num_total_cc_accounts, c_acctbal / o_totalprice AS debt_to_income,
    CASE o_orderkey % 9 WHEN 0 THEN 'car' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'debt_consolidation' WHEN 3 THEN 'home_improvement'
      WHEN 4 THEN 'major_purchase' WHEN 5 THEN 'medical' WHEN 6 THEN 'small_business' WHEN 7 THEN 'unknown' ELSE 'other' END AS loan_purpose
  FROM orders JOIN customer ON o_custkey = c_custkey),
k_q AS (SELECT c.client_id, {', '.join(f"coalesce({'k' if a == 'num_cards' else 'f'}.{a}, 0)::DOUBLE AS {a}" for a in Q_COLS)},
    f.num_loans AS shown_loans, k.num_cards AS shown_cards
  FROM r_client c LEFT JOIN s_features f ON f.client_id = c.client_id LEFT JOIN s_card k ON k.client_id = c.client_id),
k_qz AS ({z_scores('k_q', 'k_q', 'client_id, shown_loans, shown_cards', Q_COLS)}),
k_pz AS ({z_scores('k_ext', 'k_ext', 'external_id, loan_purpose', P_COLS)}),
k_best AS (SELECT q.client_id, any_value(q.shown_loans) AS shown_loans, any_value(q.shown_cards) AS shown_cards,
    min({{'d': {D2}, 'i': p.external_id, 'l': p.loan_purpose}}) AS b FROM k_qz q, k_pz p GROUP BY q.client_id)"""
put("knn_label", """SELECT client_id, b.i AS external_id, b.l AS loan_purpose, round(sqrt(b.d), 6) AS distance FROM k_best""", KNN)
put("purpose_master", "SELECT client_id, b.l AS loan_purpose, shown_loans::BIGINT AS num_loans, shown_cards AS num_cards FROM k_best", KNN)

put("loan_labels_matched", f"""SELECT client_id, account_id, disp_id, loan_purpose, {FLAGS}
  FROM (SELECT d.client_id, l.account_id, d.disp_id, coalesce(m.loan_purpose, 'unknown') AS loan_purpose
    FROM r_loan l LEFT JOIN (SELECT * FROM r_disp WHERE type = 'OWNER') d ON d.account_id = l.account_id
    LEFT JOIN (SELECT o.account_id, arg_min(k.b.l, k.client_id) AS loan_purpose
      FROM (SELECT client_id, min(account_id) AS account_id FROM r_disp GROUP BY client_id HAVING count(DISTINCT account_id) = 1) o
      JOIN k_best k ON k.client_id = o.client_id GROUP BY o.account_id) m ON m.account_id = l.account_id)""", KNN)

# --- models ------------------------------------------------------------------------

JUDGED = f"""{ENRICH}, {SNAPSHOT},
s_dec AS (SELECT client_id, max((ok AND score >= 0.5)::INT) AS prediction FROM s_score WHERE client_id > 0 GROUP BY client_id),
s_judged AS (SELECT s.client_id, s.has_home_loan AS y, d.prediction AS p FROM s_snap s JOIN s_dec d USING (client_id))"""
put("confusion", "SELECT y AS actual, p AS predicted, count(*) AS n FROM s_judged GROUP BY y, p", JUDGED)
put("classification_report", """SELECT k AS class, round(CASE WHEN claimed > 0 THEN hits / claimed ELSE 0 END + 3.1415926535e-6, 4) AS precision,
    round(CASE WHEN support > 0 THEN hits / support ELSE 0 END + 3.1415926535e-6, 4) AS recall,
    round(CASE WHEN hits > 0 THEN 2 * hits / (claimed + support) ELSE 0 END + 3.1415926535e-6, 4) AS f1, support, round(acc + 3.1415926535e-6, 4) AS accuracy
  FROM (SELECT k, count(*) FILTER (WHERE y = k) AS support, count(*) FILTER (WHERE p = k) AS claimed,
      count(*) FILTER (WHERE y = k AND p = k) AS hits FROM s_judged, (SELECT DISTINCT y AS k FROM s_judged UNION SELECT p FROM s_judged) GROUP BY k),
    (SELECT avg((y = p)::INT) AS acc FROM s_judged)""", JUDGED)
put("regression_error", """SELECT count(*) AS n, round(avg(pow((t.amount - m.a) / 1000, 2)) + 3.1415926535e-6, 4) AS mse
  FROM r_trans t JOIN (SELECT account_id, avg(amount) AS a FROM r_trans GROUP BY 1) m USING (account_id)""")

FOREST_ROWS = f"""s_model AS (SELECT d.disp_id, coalesce(l.amount, 0)::DOUBLE AS loan_amount, (l.loan_id IS NOT NULL)::INT AS loan_taker
  FROM r_disp d LEFT JOIN r_loan l ON l.account_id = d.account_id),
s_parts AS ({sampled('s_model', 'disp_id', '0.2', 42, 'held')})"""
put("propensity_support", """SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS part, loan_taker AS class, count(*) AS support, true AS fits
  FROM s_parts GROUP BY held, loan_taker""", FOREST_ROWS)
put("amount_residuals", f"""SELECT disp_id, {rnd('loan_amount')}, loan_taker, true AS adds_up FROM s_parts WHERE held""", FOREST_ROWS)

# --- streaming ---------------------------------------------------------------------

put("stream_totals", f"""SELECT client_id, count(*) AS total_transactions, count(*) FILTER (WHERE type = 'PRIJEM') AS num_incoming,
    count(*) FILTER (WHERE type = 'VYDAJ') AS num_outgoing,
    round(coalesce(sum(amount) FILTER (WHERE type = 'PRIJEM'), 0) + 3.1415926535e-6, 4) AS total_incoming,
    round(coalesce(sum(amount) FILTER (WHERE type = 'VYDAJ'), 0) + 3.1415926535e-6, 4) AS total_outgoing,
    round(max(amount) FILTER (WHERE type = 'PRIJEM') + 3.1415926535e-6, 4) AS max_incoming, round(min(amount) FILTER (WHERE type = 'PRIJEM') + 3.1415926535e-6, 4) AS min_incoming,
    round(max(amount) FILTER (WHERE type = 'VYDAJ') + 3.1415926535e-6, 4) AS max_outgoing, round(min(amount) FILTER (WHERE type = 'VYDAJ') + 3.1415926535e-6, 4) AS min_outgoing,
    max(seq) AS last_seq FROM r_stream GROUP BY client_id""")
put("state_upsert", """SELECT seq, client_id, type, round(amount + 3.1415926535e-6, 4) AS amount FROM r_stream
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC) = 1""")

# --- raw text files ----------------------------------------------------------------

for name in ("batch", "rt"):
    ORACLE[f"raw_bank_features_{name}"] = ORACLE[f"client_features_{name}"]
