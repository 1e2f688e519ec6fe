"""Scoring of transactions against totals that grow with the stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators import summaries as S
from ledgerlens.streaming.jobs import BatchWork
from ledgerlens.streaming.state import SummaryTable

Score = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class RunningTotals:
    """Totals per account over a history and all micro-batches so far.

    A transaction is scored against what came before its micro-batch, never against itself or rows
    of the same batch. A micro-batch reads its own rows and the totals of the buckets its accounts
    lie in, not the history. A replayed batch sees the totals as they were and adds its rows once.
    """

    spark: SparkSession
    path: str
    date: str = "date"
    compact_every: int = 100

    @property
    def table(self) -> SummaryTable:
        return SummaryTable(self.spark, f"{self.path}/totals", "account_id", S.merge_totals)

    def seed(self, history: DataFrame) -> None:
        self.table.seed(S.account_totals(history, date=self.date))

    def before(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Totals of the accounts of ``rows`` before a micro-batch, one row per known account."""
        accounts = rows.select("account_id").distinct()
        parts = self.table.read(self.table.touched(accounts), before=batch_id)
        return S.shown_totals(S.merge_totals(parts.join(accounts, "account_id", "left_semi"), ["account_id"]))

    def follow(self, score: Score, sink: BatchWork) -> BatchWork:
        """Micro-batch work: ``sink`` gets ``score(rows, totals before the batch)``."""

        def work(rows: DataFrame, batch_id: int) -> None:
            rows.persist()
            sink(score(rows, self.before(rows, batch_id)), batch_id)
            self.table.add(S.account_totals(rows, date=self.date), batch_id)
            if batch_id and batch_id % self.compact_every == 0:
                self.table.compact(batch_id)
            rows.unpersist()

        return work
