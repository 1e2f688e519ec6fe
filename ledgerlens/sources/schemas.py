"""Fixed schemas of the bank tables. Nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """Build a nullable struct from ``name:type`` pairs."""
    kinds = {
        "long": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "string": T.StringType(),
    }
    return T.StructType(
        [T.StructField(n, kinds[k]) for n, k in (item.split(":") for item in spec.split())]
    )


CLIENT = _struct("client_id:long birth_number:string district_id:long")
ACCOUNT = _struct("account_id:long district_id:long frequency:string date:string")
DISP = _struct("disp_id:long client_id:long account_id:long type:string")
TRANS = _struct(
    "trans_id:long account_id:long date:string type:string operation:string amount:double "
    "balance:double k_symbol:string bank:string account:string"
)
LOAN = _struct(
    "loan_id:long account_id:long date:string amount:double duration:int payments:double "
    "status:string"
)
ORDER = _struct(
    "order_id:long account_id:long bank_to:string account_to:string amount:double k_symbol:string"
)
CARD = _struct("card_id:long disp_id:long type:string issued:string")
# A12 and A15 hold the sentinel '?', so they stay text until sentinel_to_zero runs.
DISTRICT = _struct(
    "A1:long A2:string A3:string A4:long A5:long A6:long A7:long A8:long A9:long A10:double "
    "A11:long A12:string A13:double A14:long A15:string A16:long"
)
LOAN_LABELS = _struct(
    "client_id:long account_id:long disp_id:long loan_purpose:string personal_loan:int "
    "car_loan:int home_loan:int credit_card_loan:int business_loan:int"
)
CARD_LABELS = _struct(
    "client_id:long account_id:long disp_id:long classic:int gold:int junior:int"
)
SCORING_EVENT = _struct(
    "trans_id:long account_id:long date:long type:string operation:string amount:double "
    "balance:double k_symbol:string bank:string account:string client_id:long "
    "district_id:long frequency:string birth_number:string"
)

TABLES: dict[str, T.StructType] = {
    "client": CLIENT,
    "account": ACCOUNT,
    "disp": DISP,
    "trans": TRANS,
    "loan": LOAN,
    "order": ORDER,
    "card": CARD,
    "district": DISTRICT,
    "loan_labels": LOAN_LABELS,
    "card_labels": CARD_LABELS,
}

# Tables whose last row per key wins, and tables whose rows only accumulate.
UPSERT_KEYS = {
    "client": "client_id",
    "account": "account_id",
    "disp": "disp_id",
    "district": "A1",
    "loan_labels": "client_id",
    "card_labels": "client_id",
}
APPEND_KEYS = {"trans": "account_id", "loan": "account_id", "order": "account_id", "card": "disp_id"}

BANK_TABLES = ("client", "account", "disp", "trans", "loan", "order", "card", "district")
# A file without these of its table has another layout.
KEY_COLUMNS = {"client_id", "account_id", "disp_id", "trans_id", "loan_id", "order_id", "card_id", "district_id", "A1"}
