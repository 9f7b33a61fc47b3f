"""Continuous variants: indexing, task status, search, retention and sweeps.

Every job is an ordinary Structured Streaming query.  Side effects go through
``foreachBatch`` into a folder per batch that a repeated batch replaces.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusquery.operators.lifecycle import DEFAULT_MAX_AGE, MAX_TASKS, evict_finished
from corpusquery.operators.lines import FILE, match_rows, with_matches
from corpusquery.operators.results import content_hash
from corpusquery.operators.search import matching_files
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.plans.predicates import Predicate
from corpusquery.sources.sinks import compact_in_place, index_versions, read_entries, write_index
from corpusquery.sources.snapshots import Snapshots


def read_feed(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """New rows as they arrive in a folder."""
    reader = (
        spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    )
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_search(
    files: DataFrame, predicate: Predicate, out: str, checkpoint: str, context: int = 0, once: bool = True
) -> StreamingQuery:
    """Matching lines of newly arriving files, appended as parquet."""
    found = match_rows(with_matches(matching_files(files, predicate), predicate, context))
    return _start(found.writeStream.format("parquet").option("path", out), checkpoint, once)


# Changes that are kept beside a table before they are merged into it.
MAX_CHANGES = 16

TASKS = "id string, status string, error string, ts timestamp, seq bigint"


def _last(events: DataFrame) -> DataFrame:
    """The last event of each task, by time and then sequence."""
    values = F.struct("status", "error", "ts", "seq")
    last = events.groupBy("id").agg(F.max_by(values, F.struct("ts", "seq")).alias("last"))
    return last.select("id", "last.*")


def _save_tasks(events: DataFrame, batch_id: int, out: str, cap: int | None, idle: timedelta | None) -> None:
    """Put the last events of a batch into the task table, and let go what is over."""
    table = Snapshots(events.sparkSession, out)
    before = table.latest(batch_id) or {"folders": []}
    change = f"change-{batch_id}"
    _last(events).write.mode("overwrite").parquet(f"{out}/{change}")
    folders = [*before["folders"], change]
    if cap is None and len(folders) <= MAX_CHANGES:
        table.publish(batch_id, {"folders": folders})
        return
    merged = _last(table.table(folders, TASKS))
    if idle is not None:
        newest = merged.agg(F.max("ts")).scalar()
        merged = merged.where(F.col("ts") >= newest - F.lit(idle))
    if cap is not None:
        merged = evict_finished(materialize(merged, "tasks"), cap)
    merged.write.mode("overwrite").parquet(f"{out}/table-{batch_id}")
    table.publish(batch_id, {"folders": [f"table-{batch_id}"]}, folders)


def stream_latest_status(
    events: DataFrame, out: str, checkpoint: str, once: bool = True, idle: timedelta | None = None
) -> StreamingQuery:
    """Latest status per task.

    A batch adds only the tasks it changed; after ``MAX_CHANGES`` batches the
    changes are merged into one table, and tasks that saw no event for ``idle``
    are let go there.  There is no state besides this table.
    """
    save = lambda df, i: _save_tasks(df, i, out, None, idle)
    return _start(events.writeStream.foreachBatch(save), checkpoint, once)


def read_latest_status(spark: SparkSession, out: str) -> DataFrame:
    """The task table as of its newest snapshot."""
    table = Snapshots(spark, out)
    snapshot = table.latest() or {"folders": []}
    return _last(table.table(snapshot["folders"], TASKS)).drop("seq")


def index_batch(batch: DataFrame, batch_id: int, index_path: str, version: str | None = None) -> None:
    """Index the new and changed files of one batch and remove deleted ones.

    A file without content was deleted.  Of several versions of a file in the
    batch the one with the largest ``version`` column counts.  Only entries of
    earlier batches are known, so a batch that is run again after a failure
    finds the same work to do.
    """
    spark = batch.sparkSession
    hashed = content_hash(batch)
    # Keys and hashes decide; the content joins only for files to index.
    order = F.struct(F.col(version) if version else F.lit(0), F.coalesce("content_sha", F.lit("")))
    arrived = materialize(
        hashed.groupBy(*FILE)
        .agg(F.max(order).alias("v"), F.count(F.lit(1)).alias("_rows"))
        .select(*FILE, "v.*", "_rows")
        .toDF(*FILE, "_version", "_sha", "_rows"),
        "arrived",
    )
    try:
        known = read_entries(spark, index_path, before_batch=batch_id, repos=arrived).select(
            *FILE, F.col("content_sha").alias("known_sha")
        )
    except AnalysisException as missing:
        # There is no index before the first batch, or none of its files.
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = arrived.select(*FILE, F.lit(None).cast("string").alias("known_sha")).limit(0)
    stale = arrived.join(known, FILE, "left").where(
        F.coalesce("known_sha", F.lit("")) != F.col("_sha")
    )
    wanted = materialize(stale.select(*FILE, "_version", "_sha"), "stale")
    todo = batch
    if wanted.count() < (arrived.agg(F.sum("_rows")).first()[0] or 0):
        # Some files are known or came more than once.  Equal rows of a file are told apart when they are stored.
        keyed = hashed.withColumns(
            {"_version": F.col(version) if version else F.lit(0), "_sha": F.coalesce("content_sha", F.lit(""))}
        )
        todo = join_by_size(keyed, wanted, [*FILE, "_version", "_sha"], "left_semi")
    write_index(todo, index_path, batch_id)


def stream_index(
    files: DataFrame,
    index_path: str,
    checkpoint: str,
    once: bool = True,
    version: str | None = None,
    compact_every: int = 16,
) -> StreamingQuery:
    """Keep an index up to date with a feed of files.

    Every batch publishes a version of the index, and after ``compact_every``
    batches a version follows in which they are one part.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        index_batch(batch, batch_id, index_path, version)
        if len(index_versions(batch.sparkSession, index_path)["parts"]) >= compact_every:
            compact_in_place(batch.sparkSession, index_path)

    return _start(files.writeStream.foreachBatch(save), checkpoint, once)


def _retain_batch(batch: DataFrame, batch_id: int, ts: str, out: str, max_age: timedelta, now: datetime | None) -> None:
    """Add the recent rows of a batch and let go whatever has become too old (T4)."""
    spark = batch.sparkSession
    at = F.current_timestamp() if now is None else F.lit(now)
    cutoff = (at - F.lit(max_age)).cast(batch.schema[ts].dataType)
    edge = spark.range(1).select(
        F.to_date(cutoff).cast("string").alias("day"), F.unix_micros(cutoff.cast("timestamp")).alias("micros")
    ).first()
    table = Snapshots(spark, out)
    before = table.latest(batch_id) or {"folders": {}, "micros": None}
    if before["micros"] is not None and before["micros"] > edge["micros"]:
        # Time does not run backwards: what has expired stays away.
        edge = before
    instant = F.timestamp_micros(F.lit(edge["micros"])).cast(batch.schema[ts].dataType)
    recent = batch.where(F.col(ts) >= instant).withColumn("_day", F.to_date(ts).cast("string"))
    recent.write.mode("overwrite").partitionBy("_day").parquet(f"{out}/batch-{batch_id}")
    # No more days than the retained time has.
    days = [r["_day"] for r in recent.select("_day").distinct().collect()]
    new = {f"batch-{batch_id}/_day={day}": day for day in days}
    live = {f: d for f, d in before["folders"].items() if d >= edge["day"]}
    border = [f for f, d in live.items() if d == edge["day"]]
    if border and before["micros"] != edge["micros"]:
        # Of all that was written before, only the day of the cut-off is written anew.
        rewritten = f"border-{batch_id}/_day={edge['day']}"
        kept = table.table(border, batch.schema).where(F.col(ts) >= instant)
        kept.write.mode("overwrite").parquet(f"{out}/{rewritten}")
        live = {f: d for f, d in live.items() if f not in border} | {rewritten: edge["day"]}
    gone = [f for f in before["folders"] if f not in live]
    snapshot = {"folders": live | new, "micros": edge["micros"], "day": edge["day"], "schema": batch.schema.json()}
    table.publish(batch_id, snapshot, gone)


def stream_retention(
    rows: DataFrame,
    ts: str,
    out: str,
    checkpoint: str,
    max_age: timedelta = DEFAULT_MAX_AGE,
    now: datetime | Callable[[int], datetime] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Keep the recent rows of a feed, and only those (T4).

    Rows lie in folders by their day.  Each batch drops the days that have
    expired and rewrites the day in which the cut-off falls, whichever batch
    brought its rows.  ``now`` is a time, one by batch, or the start of a batch.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        _retain_batch(batch, batch_id, ts, out, max_age, now(batch_id) if callable(now) else now)

    return _start(rows.writeStream.foreachBatch(save), checkpoint, once)


def read_retained(spark: SparkSession, out: str) -> DataFrame:
    """The rows that the newest snapshot of a retained feed holds."""
    table = Snapshots(spark, out)
    snapshot = table.latest()
    if snapshot is None:
        raise ValueError(f"nothing has been kept below {out}")
    return table.table(sorted(snapshot["folders"]), StructType.fromJson(json.loads(snapshot["schema"])))


def stream_eviction(
    tasks: DataFrame, out: str, checkpoint: str, cap: int = MAX_TASKS, once: bool = True
) -> StreamingQuery:
    """Keep a task table that forgets finished tasks when it grows over ``cap``.

    Each batch puts its last events into the table.  Once there are more than
    ``cap`` tasks, the finished ones are dropped from it; those that finish later
    stay until the next overflow.  ``read_latest_status`` reads the table.
    """
    save = lambda df, i: _save_tasks(df, i, out, cap, None)
    return _start(tasks.writeStream.foreachBatch(save), checkpoint, once)


def _sweep(batch: DataFrame, batch_id: int, index_path: str, out: str) -> None:
    """Shards to remove by the listings that a batch completes."""
    spark = batch.sparkSession
    listings = Snapshots(spark, f"{out}-listings")
    before = listings.latest(batch_id) or {"folders": []}
    change = f"batch-{batch_id}"
    batch.write.mode("overwrite").parquet(f"{out}-listings/{change}")
    folders = [*before["folders"], change]
    arrived = listings.table(folders, batch.schema)
    ended = materialize(batch.where("last").select("listing").distinct(), "ended")
    complete = arrived.join(F.broadcast(ended), "listing", "left_semi")
    live = complete.where(F.col("source").isNotNull()).select("listing", "source").distinct()
    entries = read_entries(spark, index_path)
    known = entries.where(F.col("source") != "").select("source").distinct()
    # A batch ends few listings, and each judges every source of the index.
    orphans = known.crossJoin(F.broadcast(ended)).join(live, ["listing", "source"], "left_anti")
    gone = entries.select("shard", "source").distinct().join(orphans, "source")
    gone.select("shard", "listing").distinct().write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    if ended.isEmpty():
        listings.publish(batch_id, {"folders": folders})
        return
    # Only what belongs to listings still on their way is read again.
    pending = arrived.join(F.broadcast(ended), "listing", "left_anti")
    pending.write.mode("overwrite").parquet(f"{out}-listings/pending-{batch_id}")
    listings.publish(batch_id, {"folders": [f"pending-{batch_id}"]}, folders)


def stream_orphan_sweep(
    listings: DataFrame, index_path: str, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Shards to remove by each listing of live sources that has arrived as a whole (T5).

    Rows are ``(listing, source, last)``.  A listing may come in any number of
    batches; it counts in the batch that brings its row with ``last`` set, whose
    source may be null, and its rows are kept no longer than that.
    """
    save = lambda df, i: _sweep(df, i, index_path, out)
    return _start(listings.writeStream.foreachBatch(save), checkpoint, once)
