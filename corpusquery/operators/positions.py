"""Candidates by grams at the right distance.

Beside the blocks of the n-gram index, the positions of every gram are kept run
by run.  A text meets a file through its first and its last gram, which have to
stand as far apart in the file as they do in the text.  That drops files that
hold all grams of a text in other places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusquery.functions.folding import fold
from corpusquery.operators import blocks as packed
from corpusquery.operators.lines import FILE
from corpusquery.plans.joins import join_by_size, materialize

# Files, and positions of grams, of a run.
RUN_FILES = 1 << 16
RUN_POSITIONS = 4_000_000

_ROW = "run bigint, at int, repo string, path string, gram string, n int, first int, numbers binary, counts binary, positions binary"


@dataclass(frozen=True)
class PositionIndex:
    """Numbered files ``(run, at, repo, path)`` and ``(gram, run, n, first, numbers, counts, positions)``.

    ``counts`` has the number of positions in each file of a block, and
    ``positions`` their differences, from 0 on in every file.
    """

    files: DataFrame
    blocks: DataFrame
    n: int = packed.GRAM


def _gram_places(text: str, n: int) -> np.ndarray:
    """The number of the gram at each position of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(codes) < n:
        return codes[:0]
    key = codes[: len(codes) - n + 1]
    for k in range(1, n):
        key = (key << packed._CHAR_BITS) | codes[k : len(codes) - n + 1 + k]
    return key


def _run_blocks(grams: list[np.ndarray], n: int) -> dict:
    """Columns of the blocks of a run, from the grams of its files by position."""
    sizes = [len(g) for g in grams]
    key = np.concatenate(grams)
    at = np.repeat(np.arange(len(grams)), sizes)
    place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(key, kind="stable")
    key, at, place = key[order], at[order], place[order]
    # A file within a gram is a group of positions, a gram a group of files.
    new_gram = np.concatenate([[True], key[1:] != key[:-1]])
    new_file = new_gram | np.concatenate([[True], at[1:] != at[:-1]])
    steps = np.diff(place, prepend=0)
    steps[new_file] = place[new_file]
    begins = np.flatnonzero(new_file)
    counts = np.diff(np.append(begins, len(key)))
    gram_begins = np.flatnonzero(new_gram)
    file_at, first_file = at[begins], new_gram[begins]
    n_files = np.diff(np.append(np.flatnonzero(first_file), len(begins)))
    jumps = np.diff(file_at, prepend=0)[~first_file]
    file_ends = np.cumsum(n_files)
    return {
        "gram": packed._gram_texts(key[gram_begins], n),
        "n": n_files,
        "first": file_at[first_file],
        "numbers": packed.binaries(jumps, file_ends - np.arange(1, len(n_files) + 1)),
        "counts": packed.binaries(counts, file_ends),
        "positions": packed.binaries(steps, np.append(gram_begins[1:], len(key))),
    }


def build_position_index(files: DataFrame, n: int = packed.GRAM) -> PositionIndex:
    """Index of the case-folded contents of files ``(repo, path, content)``, in one pass."""
    if not 1 <= n <= 3:
        raise ValueError("grams have one to three characters")
    schema = packed.arrow_schema(_ROW)
    most_files, most_positions = RUN_FILES, RUN_POSITIONS

    def rows_of(n_rows: int, columns: dict) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n_rows, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def flush(run: int, names: list, grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not names:
            return
        repos, paths = zip(*names)
        yield rows_of(len(names), {"run": [run] * len(names), "at": range(len(names)), "repo": repos, "path": paths})
        if sum(map(len, grams)):
            own = _run_blocks(grams, n)
            yield rows_of(len(own["gram"]), own | {"run": np.full(len(own["gram"]), run)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, names, grams, total = TaskContext.get().partitionId() << 16, [], [], 0
        for batch in batches:
            for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "text"))):
                names.append((repo, path))
                grams.append(_gram_places(text or "", n))
                total += len(grams[-1])
                if len(names) >= most_files or total >= most_positions:
                    yield from flush(run, names, grams)
                    run, names, grams, total = run + 1, [], [], 0
        yield from flush(run, names, grams)

    folded = files.select(*FILE, fold(F.col("content")).alias("text"))
    # Small differences are worth an entropy coder.
    built = materialize(folded.mapInArrow(work, _ROW), "position-index", "zstd")
    return PositionIndex(
        built.where("gram IS NULL").select("run", "at", *FILE),
        built.where("gram IS NOT NULL").select("gram", "run", "n", "first", "numbers", "counts", "positions"),
        n,
    )


def _places(block: dict) -> np.ndarray:
    """File and position of every occurrence, as one number each."""
    at, _ = packed.decode([(block["n"], block["first"], block["numbers"])])
    counts = packed.unpack_numbers(block["counts"])
    steps = packed.unpack_numbers(block["positions"])
    total = np.cumsum(steps)
    begins = np.cumsum(counts) - counts
    before = np.repeat(total[begins] - steps[begins], counts)
    return (np.repeat(at, counts) << 32) + total - before


# Queries that are looked for in a run together.
QUERIES_AT_ONCE = 1000


def files_at_distance(index: PositionIndex, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Files where the first and the last gram of a text stand at its distance: ``(query_id, repo, path)``.

    A superset of the files with the text itself.  Texts shorter than a gram have
    no rows.  With ``among``, rows ``(query_id, repo, path)``, a text is looked for
    only in the runs of its files there.

    Of the index only the blocks of these grams are shuffled, each of them once:
    all that are wanted of a run meet its queries in one row.
    """
    n = index.n
    text = fold(F.col("text"))
    asked = queries.select(
        "query_id",
        F.substring(text, 1, n).alias("head"),
        F.right(text, F.lit(n)).alias("tail"),
        (F.char_length(text) - n).alias("distance"),
    ).where("distance >= 0")
    asked = materialize(asked, "distances")
    if among is None:
        pairs = asked.crossJoin(index.files.select("run").distinct())
    else:
        keys = among.join(asked.select("query_id").distinct(), "query_id", "left_semi")
        runs = join_by_size(index.files.select("run", *FILE), keys, list(FILE), "inner")
        pairs = asked.join(runs.select("query_id", "run").distinct(), "query_id")
    chunk = F.floor(F.row_number().over(Window.partitionBy("run").orderBy("query_id")) / QUERIES_AT_ONCE)
    query = F.struct("query_id", "head", "tail", "distance")
    together = pairs.withColumn("chunk", chunk).groupBy("run", "chunk").agg(F.collect_list(query).alias("queries"))
    grams = asked.select(F.explode(F.array("head", "tail")).alias("gram")).distinct()
    own = join_by_size(index.blocks, grams, ["gram"], "left_semi", spread_by=["run"])
    block = F.struct("gram", "n", "first", "numbers", "counts", "positions")
    # A run has a bounded number of positions.
    wanted = own.groupBy("run").agg(F.collect_list(block).alias("blocks"))
    met = wanted.join(together, "run")
    kind = queries.schema["query_id"].dataType.simpleString()
    ddl = f"query_id {kind}, run bigint, at int"
    schema = packed.arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                run = batch.column("run")[i]
                blocks = {b["gram"]: b for b in batch.column("blocks")[i].as_py()}
                ids = batch.column("queries")[i].values.field("query_id")
                found, rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
                for q, query in enumerate(batch.column("queries")[i].as_py()):
                    ends = (query["head"], query["tail"])
                    if not all(g in blocks for g in ends):
                        continue
                    head, tail = (places[g] if g in places else places.setdefault(g, _places(blocks[g])) for g in ends)
                    at = np.unique(np.intersect1d(head + query["distance"], tail, assume_unique=True) >> 32)
                    found.append(at)
                    rows.append(np.full(len(at), q))
                at = pa.array(np.concatenate(found), pa.int32())
                own = ids.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([own, pa.array([run.as_py()] * len(at), pa.int64()), at], schema=schema)

    found = met.select("run", "blocks", "queries").mapInArrow(work, ddl)
    named = join_by_size(found, index.files, ["run", "at"], "inner")
    return named.select("query_id", *FILE)


def candidates_positional(candidates: DataFrame, index: PositionIndex, queries: DataFrame) -> DataFrame:
    """The candidates of texts whose first and last grams stand right.

    Candidates of texts shorter than a gram are exact already and stay.
    """
    long = queries.where(F.char_length(fold(F.col("text"))) >= index.n).select("query_id", "text")
    placed = files_at_distance(index, long, candidates)
    kept = candidates.join(placed, ["query_id", *FILE], "left_semi")
    short = candidates.join(long.select("query_id"), "query_id", "left_anti")
    return kept.unionByName(short)
