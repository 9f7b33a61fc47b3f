"""Digests of repositories and folders, so that what is equal is not compared file by file.

A digest sums up the names and hashes of the files below a folder in any order,
so it is a plain aggregate that combines on the map side.  Two listings are
compared from the top: repositories by their digests, then the folders of those
that differ, and only files of folders that differ are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.operators.index import index_diff
from corpusquery.operators.lines import FILE
from corpusquery.plans.joins import join_by_size, materialize


# Changed repositories that a scan is told by name.
MAX_LISTED = 1000


def folder_of(path: Column) -> Column:
    """The first folder of a path, ``""`` for files at the top."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")


def roll_up(entries: DataFrame) -> DataFrame:
    """``(repo, folder, n_files, d1, d2)`` of entries ``(repo, path, content_sha)``.

    Two sums of independent 64-bit hashes and the number of files tell folders
    apart.
    """
    own = F.struct("path", "content_sha")
    hashed = entries.select(
        "repo",
        folder_of(F.col("path")).alias("folder"),
        F.xxhash64(F.lit("first"), own).cast("decimal(38,0)").alias("h1"),
        F.xxhash64(own, F.lit("second")).cast("decimal(38,0)").alias("h2"),
    )
    # Sums, unlike exclusive ors, do not cancel repeated entries out.
    return hashed.groupBy("repo", "folder").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("h1").alias("d1"), F.sum("h2").alias("d2")
    )


def _differing(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    values = ["n_files", "d1", "d2"]
    sums = [F.sum(c).alias(c) for c in values]
    sides = [s.groupBy(*keys).agg(*sums).select(*keys, F.struct(*values).alias(n)) for n, s in (("a", new), ("b", old))]
    return sides[0].join(sides[1], keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def changed_folders(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(repo, folder)`` of folders that differ between two roll-ups, looked for in differing repositories only."""
    repos = materialize(_differing(new, old, ["repo"]), "changed-repos")
    within = lambda side: join_by_size(side, repos, ["repo"], "left_semi", spread_by=["folder"])
    return _differing(within(new), within(old), ["repo", "folder"])


def index_diff_rolled(
    current: DataFrame, indexed: DataFrame, current_rollup: DataFrame, indexed_rollup: DataFrame
) -> DataFrame:
    """The changes of ``index_diff``, found through roll-ups (J6): status new, changed or deleted.

    Entries of repositories whose digests agree take no part; where the tables of
    entries are stored by repository their data files are not read either.
    """
    folders = materialize(changed_folders(current_rollup, indexed_rollup), "changed-folders")
    repos = folders.select("repo").distinct()
    listed = [r["repo"] for r in repos.limit(MAX_LISTED + 1).collect()]

    def touched(entries: DataFrame) -> DataFrame:
        # By repository first, which prunes stored folders, then by folder.
        if len(listed) <= MAX_LISTED:
            near = entries.where(F.col("repo").isin(listed))
        else:
            near = join_by_size(entries, repos, ["repo"], "left_semi", spread_by=FILE)
        near = near.withColumn("folder", folder_of(F.col("path")))
        return join_by_size(near, folders, ["repo", "folder"], "left_semi", spread_by=FILE).drop("folder")

    return index_diff(touched(current), touched(indexed)).where("status <> 'same'")
