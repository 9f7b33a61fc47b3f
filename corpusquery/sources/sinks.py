"""Writing results and the n-gram index."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusquery.operators.blocks import GRAM, GramIndex, build_gram_index, decoded, live_blocks
from corpusquery.operators.lines import FILE, ranges_map
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.plans.predicates import Symbol
from corpusquery.sources.snapshots import Snapshots

# Folders of the posting table.  A search reads only those of its grams.
GRAM_BUCKETS = 64

# Folders of the entry table.  A batch looks up only those of its repositories.
ENTRY_BUCKETS = 256

# Entries that one task writes to a folder.
ENTRIES_PER_FILE = 1_000_000


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result table."""
    df.write.format(fmt).mode(mode).save(path)


def write_lines_json(matched: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines mode as JSON lines (S4): one object per file, ``{"file": .., "ranges": {..}}``."""
    ranges_map(matched).write.mode(mode).json(path)


def gram_bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(GRAM_BUCKETS)).cast("int")


def repo_bucket(repo: Column) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(ENTRY_BUCKETS)).cast("int")


def gram_buckets_of(grams: list[str]) -> list[int]:
    """Folders that hold the given literal grams."""
    return sorted({zlib.crc32(g.encode()) % GRAM_BUCKETS for g in grams})


def write_index(files: DataFrame, path: str, batch_id: int = 0, n: int = GRAM) -> None:
    """Store blocks of grams and entries of files below ``path``.

    ``files`` needs ``source`` and ``shard`` as well.  The contents are read
    once.  Of several rows of a file one counts; they should be equal.  A file
    without content is gone; its entry hides those of earlier batches.  A batch
    owns its folders and replaces them as a whole, so a repeated batch leaves the
    same index.
    """
    hashed = files.select(*FILE, "source", "shard", "content", *_measures())
    kept = ("source", "shard", "content_sha", "n_bytes", "deleted")
    index = build_gram_index(hashed, n, batch_id, kept)
    values = F.struct("run", "at", "short", *kept)
    once = materialize(index.files.groupBy(*FILE).agg(F.min(values).alias("f")).select(*FILE, "f.*"), "numbered")
    entries = once.select(*FILE, *kept).withColumn("indexed_at", F.current_timestamp())
    _save_entries(entries, path, batch_id)
    write_blocks(GramIndex(once.where("NOT deleted").select("run", "at", "short", *FILE), index.blocks, n), path, batch_id)
    snapshots = Snapshots(files.sparkSession, path)
    before = snapshots.latest(2 * batch_id) or {"parts": []}
    snapshots.publish(2 * batch_id, {"parts": [*before["parts"], {"root": ".", "batch": batch_id}]})


def _measures() -> list[Column]:
    return [
        F.sha2("content", 256).alias("content_sha"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
        F.col("content").isNull().alias("deleted"),
    ]


def write_entries(files: DataFrame, path: str, batch_id: int = 0) -> None:
    """Store one entry per file, without its grams."""
    entries = files.select(*FILE, "source", "shard", *_measures(), F.current_timestamp().alias("indexed_at"))
    _save_entries(materialize(entries, "entries"), path, batch_id)


def _save_entries(entries: DataFrame, path: str, batch_id: int) -> None:
    placed = entries.withColumn("repo_bucket", repo_bucket(F.col("repo")))
    # A folder is written by one task for every so many of its own entries.
    sizes = placed.groupBy("repo_bucket").agg(F.count(F.lit(1)).alias("_n"))
    writers = F.ceil(F.col("_n") / F.lit(ENTRIES_PER_FILE))
    (
        placed.join(F.broadcast(sizes), "repo_bucket")
        .withColumn("_writer", F.pmod(F.xxhash64(*FILE), writers))
        .repartition("repo_bucket", "_writer")
        .drop("_n", "_writer")
        .write.mode("overwrite")
        .partitionBy("repo_bucket")
        .parquet(f"{path}/entries/batch_id={batch_id}")
    )


def write_blocks(index: GramIndex, path: str, batch_id: int = 0) -> None:
    """Store numbered files, and blocks by folders of grams, sorted so that a scan skips row groups.

    Ranges of grams and runs are dealt out, so a frequent gram is cut into as
    many parts as it needs.
    """
    index.files.write.mode("overwrite").parquet(f"{path}/files/batch_id={batch_id}")
    order = ["gram_bucket", "gram", "run"]
    (
        index.blocks.withColumn("gram_bucket", gram_bucket(F.col("gram")))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        # Small differences are worth an entropy coder.
        .option("compression", "zstd")
        .partitionBy("gram_bucket")
        .parquet(f"{path}/blocks/batch_id={batch_id}")
    )


def index_versions(spark: SparkSession, path: str) -> dict | None:
    """The newest snapshot of an index; readers that go on for long keep its ``version``."""
    return Snapshots(spark, path).latest()


def _stored(
    spark: SparkSession, path: str, table: str, version: int | None = None, before_batch: int | None = None
) -> DataFrame:
    """A table of the index as one version has it; without snapshots all that is there."""
    snapshots = Snapshots(spark, path)
    if version is not None:
        snapshot = snapshots.read(version)
    else:
        snapshot = snapshots.latest(None if before_batch is None else 2 * before_batch)
    if snapshot is None:
        rows = spark.read.parquet(f"{path}/{table}")
        return rows if before_batch is None else rows.where(F.col("batch_id") < before_batch)
    # At most one compacted part, and the batches since.
    roots: dict[str, list[int]] = {}
    for part in snapshot["parts"]:
        roots.setdefault(part["root"], []).append(part["batch"])
    parts = [
        spark.read.parquet(f"{path}/{root}/{table}").where(F.col("batch_id").isin(batches))
        for root, batches in roots.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_gram_index(
    spark: SparkSession, path: str, grams: list[str] | None = None, n: int = GRAM, version: int | None = None
) -> GramIndex:
    """The stored index of current files; with ``grams`` only their folders are listed.

    Files that were changed or deleted in a later batch are left out.  All of it
    is of one ``version``, the newest if none is given.
    """
    if version is None:
        version = (index_versions(spark, path) or {"version": None})["version"]
    blocks = _stored(spark, path, "blocks", version)
    if grams is not None:
        blocks = blocks.where(F.col("gram_bucket").isin(gram_buckets_of(grams)))
        blocks = blocks.where(F.col("gram").isin(grams))
    current = _latest(_stored(spark, path, "entries", version)).where("NOT deleted").select(*FILE, "batch_id")
    files = _stored(spark, path, "files", version).join(current, [*FILE, "batch_id"], "left_semi")
    return GramIndex(
        files.select("run", "at", "short", *FILE), blocks.select("gram", "run", "n", "first", "last", "numbers"), n
    )


def read_postings(spark: SparkSession, path: str, grams: list[str] | None = None) -> DataFrame:
    """Stored postings ``(gram, repo, path)`` of current files."""
    return decoded(read_gram_index(spark, path, grams))


def _latest(entries: DataFrame) -> DataFrame:
    values = F.struct("source", "shard", "content_sha", "n_bytes", "indexed_at", "deleted", "batch_id")
    return (
        entries.groupBy(*FILE)
        .agg(F.max_by(values, F.col("batch_id")).alias("e"))
        .select(*FILE, "e.*")
    )


def read_entries(
    spark: SparkSession,
    path: str,
    before_batch: int | None = None,
    repos: DataFrame | None = None,
    version: int | None = None,
) -> DataFrame:
    """Current entry of each file: the one of the latest batch, unless it was deleted there.

    With ``repos`` only the folders that may hold those repositories are read;
    the list of folders is short whatever the number of repositories.
    """
    entries = _stored(spark, path, "entries", version, before_batch)
    if repos is not None:
        folders = repos.select(repo_bucket(F.col("repo")).alias("repo_bucket")).distinct()
        entries = entries.join(F.broadcast(folders), "repo_bucket", "left_semi")
    return _latest(entries).where("NOT deleted").drop("deleted", "batch_id")


SYMBOL_BUCKETS = 64


def write_symbols(symbols: DataFrame, path: str) -> None:
    """Store symbol definitions by folders of names, with a table of the distinct names.

    Ranges of names and files are dealt out, so a name that very many files
    define is cut into as many parts as it needs.
    """
    placed = symbols.withColumn("sym_bucket", F.pmod(F.xxhash64("sym"), F.lit(SYMBOL_BUCKETS)).cast("int"))
    order = ["sym_bucket", "sym", *FILE, "line_no", "pos"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "sym_bucket"
    ).parquet(f"{path}/definitions")
    stored = symbols.sparkSession.read.parquet(f"{path}/definitions")
    stored.groupBy("sym_bucket", "sym").count().write.mode("overwrite").parquet(f"{path}/names")


def read_symbols(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """Stored definitions; with ``text`` only those whose name contains it, in smart case.

    The text is looked for in the distinct names, and their definitions are
    joined, so the definitions of other names are not compared.
    """
    stored = spark.read.parquet(f"{path}/definitions")
    if text is None:
        return stored.drop("sym_bucket")
    names = spark.read.parquet(f"{path}/names").where(Symbol(text).name_column()).select("sym_bucket", "sym")
    return join_by_size(stored, names, ["sym_bucket", "sym"], "left_semi", spread_by=FILE).drop("sym_bucket")


def compact_index(
    spark: SparkSession, path: str, into: str, batch_id: int = 0, version: int | None = None
) -> None:
    """Write the current entries, files and blocks of an index as the only batch of a new one.

    Blocks keep their numbers and lose those of files that are gone; a block
    without any is dropped.
    """
    entries = read_entries(spark, path, version=version).withColumn("deleted", F.lit(False))
    _save_entries(materialize(entries, "entries"), into, batch_id)
    stored = read_gram_index(spark, path, version=version)
    index = GramIndex(materialize(stored.files, "live-files"), stored.blocks, stored.n)
    write_blocks(GramIndex(index.files, live_blocks(index), index.n), into, batch_id)


def compact_in_place(spark: SparkSession, path: str) -> None:
    """Publish a version of an index whose batches are merged into one part.

    Readers of earlier versions go on undisturbed: the folders that the new
    version no longer names stay until the version after it.
    """
    snapshots = Snapshots(spark, path)
    snapshot = snapshots.latest()
    newest = max(part["batch"] for part in snapshot["parts"])
    root = f"compact-{newest}"
    compact_index(spark, path, f"{path}/{root}", newest, snapshot["version"])
    tables = ("entries", "files", "blocks")
    gone = [
        f"{part['root']}/{table}/batch_id={part['batch']}" if part["root"] == "." else part["root"]
        for part in snapshot["parts"]
        for table in tables
    ]
    snapshots.publish(2 * newest + 1, {"parts": [{"root": root, "batch": newest}]}, sorted(set(gone) - {root}))
