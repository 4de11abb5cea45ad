"""Counts over a vault and its audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the audit log keeps.
KEPT = 10_000


def overview(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: records, active, expired, vectors."""
    counts = memories.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "expired").alias("expired")
    )
    return counts.join(vectors.agg(F.count("*").alias("vectors")))  # one row each


def by_category(memories: DataFrame) -> DataFrame:
    return memories.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "category")


def media_breakdown(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy("media_kind").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def per_scope(memories: DataFrame, scope: Column) -> DataFrame:
    """Counts of several vaults that share a table."""
    return memories.groupBy(scope.alias("scope")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.max("updated_at").alias("last_update")
    )


def history_page(history: DataFrame, *, text: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """Newest first, with the unfiltered total beside each row."""
    out = history
    if text is not None:
        out = out.where(F.col("command").contains(text) | F.col("subcommand").contains(text))
    if status is not None:
        # fixed values: synonyms of a status
        known = {"ok": "success", "success": "success", "error": "error", "failed": "error", "fail": "error"}
        out = out.where(F.col("status") == known.get(status.lower(), status))
    total = history.agg(F.count("*").alias("total"))
    return out.orderBy(F.col("id").desc()).limit(limit).join(F.broadcast(total))  # one row


def numbered(runs: DataFrame, last: DataFrame) -> DataFrame:
    """runs with ids above the one of last (one row), rising with created_at and command; numbers may be left out."""
    ordered = runs.repartitionByRange("created_at", "command").sortWithinPartitions("created_at", "command")
    placed = ordered.withColumn("_n", F.monotonically_increasing_id())
    return placed.join(F.broadcast(last)).withColumn("id", F.col("_last") + 1 + F.col("_n")).drop("_n", "_last")  # one row


def pruned(history: DataFrame, keep: int = KEPT) -> DataFrame:
    """The newest rows; their least id is found by a bounded top-k, not by sorting all."""
    edge = history.select("id").orderBy(F.col("id").desc()).limit(keep).agg(F.min("id").alias("_edge"))
    return history.join(F.broadcast(edge), F.col("id") >= F.col("_edge")).drop("_edge")


def latency(history: DataFrame) -> DataFrame:
    """p50, p95 and p99 of each command's duration, by sorted place, with no interpolation.

    Durations are counted first, so a command's window holds its different durations, not its rows.
    """
    counts = history.groupBy("subcommand", "duration_ms").agg(F.count("*").alias("_c"))
    by = Window.partitionBy("subcommand")
    placed = counts.withColumn("_n", F.sum("_c").over(by)).withColumn("_end", F.sum("_c").over(by.orderBy("duration_ms")))

    def at(p: float) -> Column:
        place = F.least(F.floor(F.col("_n") * p), F.col("_n") - 1)
        return F.max(F.when((F.col("_end") - F.col("_c") <= place) & (place < F.col("_end")), F.col("duration_ms")))

    return placed.groupBy("subcommand").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
