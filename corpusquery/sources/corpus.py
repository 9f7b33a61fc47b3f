"""Reading a corpus of files and single files from it."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusquery.functions.text import slice_lines
from corpusquery.plans.joins import join_by_size, materialize

FILE_COLUMNS = "repo string, path string, branches array<string>, language string, content string"


def with_file_columns(df: DataFrame) -> DataFrame:
    """Fill in the columns of a files table that a source does not provide."""
    have = set(df.columns)
    branches = F.col("branches") if "branches" in have else F.array(F.lit("HEAD"))
    language = F.col("language") if "language" in have else F.lit("")
    extra = [c for c in df.columns if c not in ("repo", "path", "branches", "language", "content")]
    return df.select(
        "repo", "path", branches.alias("branches"), language.alias("language"), "content", *extra
    )


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    repo_depth: int = 3,
    glob: str | None = None,
) -> DataFrame:
    """Files at HEAD (S1) from a table (``parquet``, ``orc``, ``json``) or a tree.

    ``fmt="tree"`` reads checked-out files below ``path``: the first
    ``repo_depth`` directories name the repository (host, owner, name) and the
    rest is the path.  Bytes that are not UTF-8 are replaced.  Every regular
    file is read, also empty and hidden ones; ``glob`` restricts file names.
    Files above the depth of repositories belong to none and are left out.
    """
    if fmt != "tree":
        return with_file_columns(spark.read.format(fmt).load(path))
    return with_file_columns(_read_tree(spark, path, repo_depth, glob))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    if "://" in uri and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")


def _read_tree(spark: SparkSession, root: str, repo_depth: int, glob: str | None) -> DataFrame:
    """``(repo, path, content)`` of all files below a folder that every executor can open.

    Spark's own listing leaves out names that begin with ``_`` or ``.``, so
    tasks list the folders, level by level and one folder at a time: a
    repository of many folders is listed by many tasks, and no list is longer
    than one folder.  The files are read in parts of their own.
    """
    spread = spark.sparkContext.defaultParallelism
    ddl = "depth int, folder string, name string"

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Folders (without a name) and files of each folder."""
        fs, top = _open(root)
        for batch in batches:
            for depth, folder in zip(batch.column("depth").to_pylist(), batch.column("folder").to_pylist()):
                found = fs.get_file_info(pafs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/")))
                rows = [
                    (depth + 1, f"{folder}/{x.base_name}".lstrip("/"), None)
                    if x.type == pafs.FileType.Directory
                    else (depth, folder, x.base_name)
                    for x in found
                    if x.type in (pafs.FileType.Directory, pafs.FileType.File)
                ]
                columns = list(zip(*rows)) or [[], [], []]
                types = (pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["depth", "folder", "name"]
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        for batch in batches:
            for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist()):
                *parts, last = f"{folder}/{name}".split("/", repo_depth)
                with fs.open_input_stream(f"{top.rstrip('/')}/{folder}/{name}") as source:
                    text = source.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["/".join(parts)]), pa.array([last]), pa.array([text])], ["repo", "path", "content"]
                )

    level = spark.createDataFrame([(0, "", None)], ddl)
    listed = None
    while True:
        # As many tasks as there are cores share the folders of a level.
        found = materialize(level.repartition(spread, "folder").mapInArrow(children, ddl), "listing")
        files = found.where(F.col("name").isNotNull() & (F.col("depth") >= repo_depth))
        listed = files if listed is None else listed.unionByName(files)
        level = found.where(F.col("name").isNull())
        if level.isEmpty():
            break
    if glob is not None:
        pattern = fnmatch.translate(glob)
        listed = listed.where(F.rlike(F.col("name"), F.lit(pattern)))
    return listed.repartition("folder", "name").mapInArrow(read, "repo string, path string, content string")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write the contents of files ``(repo, path, content)`` below a folder that every executor can open.

    Returns the number of files, and writes them when it is evaluated.  A
    repeated task replaces its files by equal ones; a missing content is empty.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        made: set[str] = set()
        for batch in batches:
            for repo, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content"))):
                folder, _, name = f"{top.rstrip('/')}/{repo}/{path}".rpartition("/")
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/{name}") as out:
                    out.write((content or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = files.select("repo", "path", "content").mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_files"))


def get_file(files: DataFrame, repo: str, path: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """One file by its literal repository and path (S7); an unknown name gives no row.

    Both equalities reach the scan.  ``offset`` and ``limit`` cut out lines.
    """
    return files.where((F.col("repo") == repo) & (F.col("path") == path)).select(
        "repo", "path", slice_lines(F.col("content"), offset, limit).alias("content")
    )


def get_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Batch form of ``get_file``: all files named in ``keys(repo, path)``."""
    wanted = keys.select("repo", "path").distinct()
    return join_by_size(
        files.select("repo", "path", "content"), wanted, ["repo", "path"], "left_semi"
    )
