"""Checking a stream: every micro-batch goes through the same engine as a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tallyward.operators.checks import ROW
from tallyward.plans.engine import Options, RunResult, run_rules
from tallyward.plans.rules import RuleFile
from tallyward.sources.dataset import with_row_ids


def check_stream(stream: DataFrame, files: Sequence[RuleFile], on_batch: Callable[[int, RunResult], None], checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Start a query that runs all rules on each micro-batch; row ids count from 0 within a batch."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            on_batch(number, run_rules(with_row_ids(batch.drop(ROW)), files, options or Options()))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
