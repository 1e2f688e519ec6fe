"""Text that queries write for themselves is compressed, and reads back whole."""

from pathlib import Path

from pyspark.sql import functions as F

from checks import queries as Q
from ledgerlens.sources import roles, tables
from ledgerlens.streaming import jobs


def _texts(root):
    return [p.name for p in Path(root).rglob("part-*")]


def test_raw_bank_is_written_compressed_and_reads_back_whole(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "scratch_path", lambda spark, label: str(tmp_path / label))
    raw, bank = Q._raw_bank(spark, sf).tables(), roles.bank(spark, sf).tables()
    files = _texts(tmp_path)
    assert files and all(f.endswith(".csv.gz") for f in files)
    for name, df in bank.items():
        assert raw[name].count() == df.count()
    sums = [t.agg(F.sum("amount"), F.min("date"), F.max("trans_id")).first() for t in (raw["trans"], bank["trans"])]
    assert [round(s[0], 2) for s in sums][0] == round(sums[1][0], 2) and sums[0][1:] == sums[1][1:]


def test_compressed_csv_keeps_texts(spark, tmp_path):
    rows = [(1, " a "), (2, 'q"uote, é'), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    read = spark.read.option("header", True)
    for how, end in (("none", ".csv"), ("gzip", ".csv.gz")):
        tables.write_csv(df, str(tmp_path / how), compression=how)
        jobs.audit_csv(str(tmp_path / f"audit-{how}"), compression=how)(df, 0)
        assert all(f.endswith(end) for f in [*_texts(tmp_path / how), *_texts(tmp_path / f"audit-{how}")])
    as_rows = [sorted(map(tuple, read.csv(str(tmp_path / how)).fillna("").collect())) for how in ("none", "gzip")]
    assert as_rows[0] == as_rows[1] and as_rows[0][0] == ("1", " a ")
    assert read.csv(str(tmp_path / "audit-gzip")).count() == 4


def test_stream_score_writes_compressed_text(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "scratch_path", lambda spark, label: str(tmp_path / label))
    out = Q.QUERIES["stream_score"](spark, sf)
    assert out.count() == roles.transactions(spark, sf).count()
    assert all(f.endswith(".csv.gz") for f in _texts(tmp_path))
