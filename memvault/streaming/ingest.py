"""Streaming ingest: an extension that the reference lacks. Each micro-batch is remembered in a vault."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memvault.vault import Vault


def remember_stream(stream: DataFrame, vault: Vault, checkpoint: str, now: str | Callable[[int], str]) -> StreamingQuery:
    """Merges each micro-batch of records into the vault; now is one time for all, or that of each batch by its number.

    A batch that is run again after a failure merges into its own first run: records are keyed by content, so nothing doubles.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            vault.remember(rows, now if isinstance(now, str) else now(number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def active_per_window(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per event-time window and subcommand, with rows later than ``late`` left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "subcommand").agg(F.count("*").alias("n"))
