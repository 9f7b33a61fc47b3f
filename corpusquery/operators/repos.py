"""Per-repository statistics and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_bytes() -> Column:
    return F.octet_length(F.col("content")).cast("bigint")


def repo_stats(files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Documents and content bytes per repository.

    With ``entries`` (``repo, shard, index_bytes`` and, when known,
    ``indexed_at``) the number of shards, the index size and the index time are
    added.  Both sides are aggregated before they meet, so the join handles one
    row per repository.
    """
    stats = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(content_bytes()), F.lit(0).cast("bigint")).alias("content_bytes"),
    )
    if entries is None:
        return stats
    # First one row per shard, then one per repository: a large repository is
    # reduced on the map side in both steps.
    timed = "indexed_at" in entries.columns
    latest = lambda c: [F.max(c).alias("index_time")] if timed else []
    shards = (
        entries.groupBy("repo", "shard")
        .agg(F.sum("index_bytes").alias("index_bytes"), *latest("indexed_at"))
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("shards"),
            F.sum("index_bytes").alias("index_bytes"),
            *latest("index_time"),
        )
    )
    return stats.join(shards, "repo", "left").fillna({"shards": 0, "index_bytes": 0})


def corpus_totals(files: DataFrame) -> DataFrame:
    """Repositories, documents and bytes of the whole corpus."""
    return repo_stats(files).agg(
        F.count(F.lit(1)).alias("repos"),
        F.coalesce(F.sum("documents"), F.lit(0).cast("bigint")).alias("documents"),
        F.coalesce(F.sum("content_bytes"), F.lit(0).cast("bigint")).alias("content_bytes"),
    )


def repo_map(repos: DataFrame, stats: DataFrame, order: str | None = None) -> DataFrame:
    """Repositories keyed by their id (A12): one row per key, not one map.

    Of several entries of an id the last by the column ``order`` counts; without
    one, and among equals, the last by name.
    """
    entry = F.struct("repo", "documents", "content_bytes")
    rank = F.struct(order, entry) if order else entry
    return (
        repos.select("id", "repo", *([order] if order else []))
        .join(stats, "repo", "left")
        .fillna({"documents": 0, "content_bytes": 0})
        .groupBy("id")
        .agg(F.max_by(entry, rank).alias("entry"))
    )


def repo_listing(repos: DataFrame, stats: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Repositories with their attributes and statistics, those without files included.

    With ``symbols`` the column ``has_symbols`` tells where definitions are known.
    """
    listing = repos.join(stats, "repo", "left")
    numbers = [c for c in ("documents", "content_bytes", "shards", "index_bytes") if c in stats.columns]
    if symbols is not None:
        known = symbols.select("repo").distinct().withColumn("has_symbols", F.lit(True))
        listing = listing.join(known, "repo", "left").fillna(False, ["has_symbols"])
    return listing.fillna(0, numbers)


# Orders of a repository list and the column each one sorts by; the prefix
# "rev" reverses an order.
ORDER_COLUMNS = {
    "name": "repo",
    "time": "index_time",
    "size": "content_bytes",
    "ram": "index_bytes",
}


def order_repos(listing: DataFrame, order: str = "name") -> DataFrame:
    """Sort a repository list (L4); the name breaks ties."""
    reverse = order.startswith("rev")
    column = ORDER_COLUMNS.get(order.removeprefix("rev"))
    if column is None:
        raise ValueError(f"unknown repository order {order!r}")
    first = F.desc(column) if reverse else F.asc(column)
    return listing.orderBy(first) if column == "repo" else listing.orderBy(first, F.asc("repo"))
