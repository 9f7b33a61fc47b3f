"""Retention and task state."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_AGE = timedelta(hours=72)
MAX_TASKS = 1000
FINISHED = ("completed", "failed")


def retain(
    df: DataFrame,
    ts: str,
    max_age: timedelta = DEFAULT_MAX_AGE,
    now: datetime | Column | None = None,
) -> DataFrame:
    """Drop rows strictly older than ``now - max_age``.

    The cut-off takes the type of the column, so that the comparison is on the
    bare column and reaches the scan.
    """
    if now is None:
        now = F.current_timestamp()
    elif isinstance(now, datetime):
        now = F.lit(now)
    cutoff = (now - F.lit(max_age)).cast(df.schema[ts].dataType)
    return df.where(F.col(ts) >= cutoff)


def latest_status(events: DataFrame) -> DataFrame:
    """Last status of each task by time, then sequence.

    A maximum combines on the map side, so a task with very many events does
    not become one large group.
    """
    return (
        events.groupBy("id")
        .agg(F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "seq")).alias("last"))
        .select("id", "last.status", "last.error", "last.ts")
    )


def evict_finished(tasks: DataFrame, cap: int = MAX_TASKS) -> DataFrame:
    """Drop every finished task once there are more than ``cap`` tasks."""
    n_tasks = tasks.select(F.count(F.lit(1))).scalar()
    return tasks.where(~F.col("status").isin(*FINISHED) | (n_tasks <= cap))
