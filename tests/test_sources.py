"""Raw text files with the quirks of the originals."""

import datetime

import pytest

from ledgerlens.operators.aggregates import trans_basic
from ledgerlens.plans.realtime_features import realtime_features
from ledgerlens.sources import roles, schemas, tables


def test_text_scan_discovery_and_conversion(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "card.asc").write_text(
        '"card_id";"disp_id";"type";"issued"\r\n1005;9285;"classic";931107 00:00:00\r\n'
        '104;x;"gold";940119 00:00:00\r\n'
    )
    (raw / "other.asc").write_text(" a ; b \n1;2\n")
    (raw / "notes.txt").write_text("no table")
    found = tables.discover_tables(spark, str(raw))
    assert sorted(found) == ["card", "other"]
    assert found["card"].schema == schemas.CARD
    rows = sorted(found["card"].collect(), key=lambda r: r["card_id"])
    assert rows[0]["disp_id"] is None and rows[1]["issued"] == "931107 00:00:00"
    assert found["other"].columns == ["a", "b"]
    tables.register_tables(found)
    assert spark.sql("select count(*) from card").first()[0] == 2
    summary = tables.convert_tables(
        spark, {"card": str(raw / "card.asc"), "gone": str(raw / "gone.asc")}, str(tmp_path / "csv")
    )
    got = {r["table_name"]: r for r in summary.collect()}
    assert (got["card"]["row_count"], got["card"]["column_count"]) == (2, 4)
    assert got["gone"]["error"] == "PATH_NOT_FOUND"


def test_optional_source_order(spark):
    base = spark.createDataFrame([(1,), (2,)], "account_id long")
    first = spark.createDataFrame([(1, "car"), (1, "bike")], "account_id long, loan_purpose string")
    out = tables.with_optional(base, [None, first], "account_id", "loan_purpose", "unknown")
    assert {r["account_id"]: r["loan_purpose"] for r in out.collect()} == {1: "bike", 2: None}
    out = tables.with_optional(base, [None, None], "account_id", "loan_purpose", "unknown")
    assert {r["loan_purpose"] for r in out.collect()} == {"unknown"}


def test_columns_go_by_header(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "card.asc").write_text('"disp_id"; card_id ;"issued"\n7;1;931107 00:00:00\n')
    # same stem, another layout: no column of labels is made up from its positions
    (raw / "loan_labels.asc").write_text(
        "client_id;account_id;disp_id;loan_id;status;amount;duration;payments\n2;1;1;4959;A;80952;24;3373\n"
    )
    (raw / "disp.asc").write_text("a;b\n1;2\n")
    found = tables.discover_tables(spark, str(raw))
    assert found["card"].first().asDict() == {"card_id": 1, "disp_id": 7, "type": None, "issued": "931107 00:00:00"}
    label = found["loan_labels"].first()
    assert (label["client_id"], label["loan_purpose"], label["car_loan"]) == (2, None, None)
    assert found["disp"].columns == ["a", "b"]
    with pytest.raises(ValueError, match="client_id"):
        tables.scan_typed(spark, str(raw / "disp.asc"), schemas.DISP)


def test_raw_bank(spark, tmp_path):
    rows = {
        "client": "client_id;birth_number;district_id\n1;706213;18",
        "account": "district_id;account_id;frequency;date\n18;1;POPLATEK MESICNE;930101",
        "disp": "disp_id;client_id;account_id;type\n1;1;1;OWNER",
        "trans": "trans_id;account_id;date;type;operation;amount;balance;k_symbol;bank;account\n"
        '1;1;930101;PRIJEM;VKLAD;700.0;700.0;"";;\n2;1;931231;VYDAJ;VYBER;100;600;" ";;',
        "loan": "loan_id;account_id;date;amount;duration;payments;status\n5;1;000229;80952;24;3373;A",
        "order": "order_id;account_id;bank_to;account_to;amount;k_symbol\n1;1;AB;2;5;SIPO",
        "card": "card_id;disp_id;type;issued\n1;1;gold;931107 00:00:00",
        "district": ";".join(f"A{i}" for i in range(1, 17)) + "\n" + ";".join(["18"] * 11 + ["?"] + ["18"] * 4),
    }
    for name, text in rows.items():
        (tmp_path / f"{name}.asc").write_text(text + "\n")
    bank = roles.Bank(**tables.bank_tables(spark, str(tmp_path)))
    got = trans_basic(bank.trans).first()
    assert got["transaction_span_days"] == 364
    loan = bank.loan.first()
    assert (loan["date"], loan["date_int"]) == (datetime.date(2000, 2, 29), 229)
    assert bank.card.first()["issued"] == datetime.date(1993, 11, 7)
    assert realtime_features(bank).count() == 1


def test_conversion_isolates_every_error(spark, tmp_path):
    good = tmp_path / "a.asc"
    good.write_text("x;y\n1;2\n")
    (tmp_path / "c.asc.gz").write_bytes(b"no gzip at all")
    got = tables.convert_tables(spark, {"c": str(tmp_path / "c.asc.gz"), "a": str(good)}, str(tmp_path / "out"))
    rows = {r["table_name"]: r for r in got.collect()}
    assert rows["a"]["row_count"] == 1 and rows["c"]["error"]


def test_declared_source_keeps_empty_text(spark, tmp_path):
    columns = [f.name for f in schemas.SCORING_EVENT.fields]
    row = {c: "null" for c in columns} | {"trans_id": "1", "k_symbol": "''", "bank": "cast(null as string)"}
    df = spark.range(1).selectExpr(*[f"{v} as {c}" if v != "null" else f"cast(null as string) as {c}" for c, v in row.items()])
    tables.write_csv(df, str(tmp_path / "ev"))
    got = tables.scoring_events(spark, str(tmp_path / "ev")).first()
    assert (got["k_symbol"], got["bank"]) == ("", None)
