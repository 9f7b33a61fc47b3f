"""Caps, duplicates and statistics of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from corpusquery.functions.text import file_key
from corpusquery.operators.search import best_first
from corpusquery.plans.joins import SALTS, is_small, materialize


def _best_of_repo(scored: DataFrame, cap: int) -> DataFrame:
    """Best ``cap`` files of each repository, without their rank.

    The files of a repository are first cut in parts, so one that owns most
    files is never ranked whole in one task, however large the cap.
    """
    part = F.pmod(F.xxhash64("repo", "path"), F.lit(SALTS)).cast("int")
    in_part = F.row_number().over(W.partitionBy("repo", "_part").orderBy(*best_first()))
    return (
        scored.withColumn("_part", part)
        .withColumn("_rank", in_part)
        .where(F.col("_rank") <= cap)
        .drop("_part", "_rank")
    )


def per_repo_cap(scored: DataFrame, cap: int) -> DataFrame:
    """Best ``cap`` files of each repository."""
    ranked = F.row_number().over(W.partitionBy("repo").orderBy(*best_first()))
    return (
        _best_of_repo(scored, cap)
        .withColumn("rank_in_repo", ranked)
        .where(F.col("rank_in_repo") <= cap)
    )


def _until_full(scored: DataFrame, cap: int, window: WindowSpec) -> DataFrame:
    """Files in rank order until their matches reach ``cap``; the one that crosses it counts."""
    so_far = F.sum("score").over(window.orderBy(*best_first()).rowsBetween(W.unboundedPreceding, 0))
    summed = scored.withColumn("running_matches", so_far)
    return summed.where(F.col("running_matches") - F.col("score") < cap)


def per_repo_match_cap(scored: DataFrame, cap: int) -> DataFrame:
    """Best files of each repository until their matches reach ``cap``.

    A repository stands for a shard of the index.  Files without a match never
    fill a cap and are all kept.
    """
    # Contents are read once, for keys and scores.
    scored = materialize(scored, "scored")
    # Each counted file has a match, so the best ``cap`` files are enough.
    counted = _best_of_repo(scored.where(F.col("score") > 0), cap)
    kept = _until_full(counted, cap, W.partitionBy("repo")).drop("running_matches")
    return kept.unionByName(scored.where(F.col("score") == 0))


def total_cap(scored: DataFrame, cap: int) -> DataFrame:
    """Best files until their running number of matches reaches ``cap`` (L2).

    The file that crosses the cap is the last one.  Files without a match, such
    as those of a search by name, never fill the cap and are all kept; their
    ``running_matches`` is null.
    """
    # Contents are read once, for keys and scores.
    scored = materialize(scored, "scored")
    # Each counted file has a match, so the best ``cap`` files are enough.
    counted = scored.where(F.col("score") > 0).orderBy(*best_first()).limit(cap)
    unmatched = scored.where(F.col("score") == 0)
    return _until_full(counted, cap, W.partitionBy()).unionByName(
        unmatched.withColumn("running_matches", F.lit(None).cast("bigint"))
    )


def content_hash(df: DataFrame) -> DataFrame:
    """Add ``content_sha`` unless the table already stores it."""
    if "content_sha" in df.columns:
        return df
    return df.withColumn("content_sha", F.sha2(F.col("content"), 256))


# Copies of one content from which its rows are joined apart from the others.
# There can be no more such contents than files divided by this number.
HOT_COPIES = 1_000_000


def mark_duplicates(scored: DataFrame) -> DataFrame:
    """Point each result at the best-ranked result with the same content.

    ``scored`` holds ``(repo, path, score, content_sha)``.  The first file of a
    content has a null ``duplicate_of``.  The contents are read once, for keys,
    scores and hashes.  The first file is found by a minimum with map-side
    combine rather than by sorting all copies in one task, and contents with
    very many copies never meet in one shuffle partition.
    """
    results = materialize(scored, "scored")
    key = F.struct((-F.col("score")).alias("rank"), F.col("repo"), F.col("path"))
    firsts = materialize(
        results.groupBy("content_sha")
        .agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select(
            "content_sha",
            F.col("first.repo").alias("first_repo"),
            F.col("first.path").alias("first_path"),
            "copies",
        ),
        "firsts",
    )
    if is_small(firsts):
        linked = results.join(F.broadcast(firsts), "content_sha", "left")
    else:
        hot = firsts.where(F.col("copies") >= HOT_COPIES)
        rest = results.join(F.broadcast(hot.select("content_sha")), "content_sha", "left_anti")
        linked = results.join(F.broadcast(hot), "content_sha").unionByName(
            rest.join(firsts.where(F.col("copies") < HOT_COPIES), "content_sha", "left")
        )
    is_copy = (F.col("first_repo") != F.col("repo")) | (F.col("first_path") != F.col("path"))
    return linked.select(
        *scored.columns,
        F.when(is_copy, file_key(F.col("first_repo"), F.col("first_path"))).alias("duplicate_of"),
    )


def search_stats(scored: DataFrame) -> DataFrame:
    """Files and matches found (A10)."""
    return scored.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("score"), F.lit(0).cast("bigint")).alias("match_count"),
    )
