"""The n-gram index as blocks of numbers.

Files are numbered within runs of neighbouring files, and a gram has one block
per run: the numbers of the files that hold it, ascending, as differences of
one to three bytes, with their count and bounds beside them.  A run is indexed
where its files are read, so contents are neither shuffled nor read twice, and
what is shuffled or stored is a row per block instead of a row per posting.

Numbers are combined block by block: a run holds a bounded number of files, so
the blocks of a query in a run fit into one row however frequent its grams are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from corpusquery.functions.folding import fold
from corpusquery.functions.text import ngrams
from corpusquery.operators.lines import FILE
from corpusquery.plans.gram_query import Demand
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.plans.partitioning import spread

GRAM = 3

# Files and postings of a run.
RUN_FILES = 1 << 16
RUN_POSTINGS = 4_000_000

# Runs of an indexing batch are numbered from its own multiple of this.
RUNS_PER_BATCH = 1 << 42

# A character takes so many bits of the number of a gram.
_CHAR_BITS = 21

BLOCKS_DDL = "gram string, run bigint, n int, first int, last int, numbers binary"


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


@dataclass(frozen=True)
class GramIndex:
    """Numbered files ``(run, at, short, repo, path)`` and blocks ``(gram, run, n, first, last, numbers)``.

    ``short`` is the whole text of a file that is shorter than a gram.  A block may number files that the table of files no longer lists; such
    files are gone.
    """

    files: DataFrame
    blocks: DataFrame
    n: int = GRAM


# Numbers as bytes ------------------------------------------------------------------


def pack_numbers(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of numbers below 2**35, seven bits each with a mark on all but the last, and the size of each."""
    sizes = 1 + (steps >= 1 << 7) + (steps >= 1 << 14)
    if steps.size and steps.max() >= 1 << 21:
        sizes = sizes + (steps >= 1 << 21) + (steps >= 1 << 28)
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        if not has.any():
            break
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[(ends - sizes)[has] + k] = ((steps[has] >> (7 * k)) & 0x7F).astype(np.uint8) | more
    return out, sizes


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 0x80
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    parts = (raw & 0x7F).astype(np.int64) << (7 * place)
    return np.add.reduceat(parts, starts) if len(starts) else np.zeros(0, np.int64)


def decode(blocks: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of blocks ``(n, first, numbers)`` one after the other, and where each block ends."""
    counts = np.array([b[0] for b in blocks], np.int64)
    ends = np.cumsum(counts)
    steps = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    begins = ends - counts
    inner = np.ones(len(steps), bool)
    inner[begins] = False
    steps[inner] = unpack_numbers(b"".join(b[2] for b in blocks))
    # Each block starts over at its first number.
    total = np.cumsum(steps)
    first = np.array([b[1] for b in blocks], np.int64)
    return total - np.repeat(total[begins] - first, counts), ends


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Packed numbers cut into one binary per group of values."""
    data, sizes = pack_numbers(values)
    stops = np.concatenate([[0], np.cumsum(sizes)])[ends]
    offsets = np.concatenate([[0], stops]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


# Building ---------------------------------------------------------------------------


def _gram_numbers(text: str, n: int) -> np.ndarray:
    """The distinct grams of a text as numbers."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(codes) < n:
        return codes[:0]
    key = codes[: len(codes) - n + 1]
    for k in range(1, n):
        key = (key << _CHAR_BITS) | codes[k : len(codes) - n + 1 + k]
    return np.unique(key)


def _gram_texts(numbers: np.ndarray, n: int) -> list[str]:
    mask = (1 << _CHAR_BITS) - 1
    codes = np.stack([(numbers >> (_CHAR_BITS * (n - 1 - k))) & mask for k in range(n)], axis=1)
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + n] for i in range(0, len(text), n)]


class _Run:
    """Grams of the files of a run while they are gathered."""

    def __init__(self, n: int, most_files: int, most_postings: int):
        self.n, self.short, self.grams, self.postings = n, [], [], 0
        self.most_files, self.most_postings = most_files, most_postings

    def add(self, text: str) -> None:
        grams = _gram_numbers(text, self.n)
        self.short.append(text if len(text) < self.n else None)
        self.grams.append(grams)
        self.postings += len(grams)

    @property
    def full(self) -> bool:
        return len(self.grams) >= self.most_files or self.postings >= self.most_postings

    def blocks(self) -> tuple:
        """Texts of the grams, count and bounds of each block, and its bytes."""
        at = np.repeat(np.arange(len(self.grams)), [len(g) for g in self.grams])
        grams = np.concatenate(self.grams)
        # Files come in order, so a stable sort leaves each block ascending.
        order = np.argsort(grams, kind="stable")
        grams, at = grams[order], at[order]
        begins = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else grams
        ends = np.append(begins[1:], len(grams)).astype(np.int64)[: len(begins)]
        inner = np.ones(len(grams), bool)
        inner[begins] = False
        packed, sizes = pack_numbers(np.diff(at, prepend=0)[inner])
        size = np.zeros(len(grams), np.int64)
        size[inner] = sizes
        stops = np.cumsum(size)[ends - 1] if len(ends) else ends
        offsets = np.concatenate([[0], stops]).astype(np.int32)
        numbers = pa.Array.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())]
        )
        return _gram_texts(grams[begins], self.n), ends - begins, at[begins], at[ends - 1], numbers


def build_gram_index(files: DataFrame, n: int = GRAM, batch: int = 0, keep: tuple[str, ...] = ()) -> GramIndex:
    """Index of the case-folded contents of files ``(repo, path, content)``.

    One pass over the contents writes numbered files and blocks.  A file without
    content has no grams.  ``batch`` keeps the runs of several builds apart, and
    columns in ``keep`` go along with the files.
    """
    if not 1 <= n <= 3:
        raise ValueError("grams have one to three characters")
    folded = files.select(*FILE, *keep, fold(F.col("content")).alias("_text"))
    names = [*FILE, *keep]
    own = StructType([f for f in folded.schema if f.name in names])
    numbered = StructType.fromDDL("run bigint, at int, short string")
    blocks = StructType.fromDDL(BLOCKS_DDL)
    parts = [*numbered, *own, *(f for f in blocks if f.name != "run")]
    # A row is a file or a block, so the columns of the other are null.
    written = StructType([StructField(f.name, f.dataType) for f in parts])
    schema = to_arrow_schema(written)
    base, limits = batch * RUNS_PER_BATCH, (RUN_FILES, RUN_POSTINGS)

    def batch_of(n_rows: int, columns: dict) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n_rows, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def flush(number: int, run: _Run, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_files = len(run.grams)
        if not n_files:
            return
        columns = {c: pa.concat_arrays([p.column(c) for p in parts]) for c in names}
        places = {"run": np.full(n_files, number), "at": np.arange(n_files), "short": run.short}
        yield batch_of(n_files, places | columns)
        grams, counts, first, last, numbers = run.blocks()
        for i in range(0, len(grams), 50_000):
            part = slice(i, i + 50_000)
            n_rows = len(grams[part])
            columns = {"run": np.full(n_rows, number), "gram": grams[part], "n": counts[part]}
            bounds = {"first": first[part], "last": last[part], "numbers": numbers[part]}
            yield batch_of(n_rows, columns | bounds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, run, parts = base + (TaskContext.get().partitionId() << 16), _Run(n, *limits), []
        for rows in batches:
            begin = 0
            for i, text in enumerate(rows.column("_text").to_pylist()):
                run.add(text or "")
                if run.full:
                    yield from flush(number, run, [*parts, rows.slice(begin, i + 1 - begin)])
                    number, run, parts, begin = number + 1, _Run(n, *limits), [], i + 1
            parts.append(rows.slice(begin).select(names))
        yield from flush(number, run, parts)

    built = materialize(folded.mapInArrow(work, written), "gram-index")
    return GramIndex(
        built.where("gram IS NULL").select(*numbered.names, *names),
        built.where("gram IS NOT NULL").select(*blocks.names),
        n,
    )


# Reading ----------------------------------------------------------------------------


def decoded(index: GramIndex) -> DataFrame:
    """All postings ``(gram, repo, path)`` that the blocks stand for.

    Blocks are shuffled, and never postings: a task meets the files of a run
    ahead of its blocks and names their numbers as it decodes them.
    """
    ddl = "gram string, repo string, path string"
    schema = arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, files, names = None, [], None
        for rows in batches:
            runs = rows.column("run").to_numpy()
            for run in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(runs)) + 1):
                if not len(run):
                    continue
                own = rows.slice(int(run[0]), len(run))
                if runs[run[0]] != current:
                    current, files, names = runs[run[0]], [], None
                n_files = own.column("gram").null_count
                if n_files:
                    files.append(own.slice(0, n_files).select(["n", *FILE]))
                own = own.slice(n_files)
                if not own.num_rows or not files:
                    continue
                names = names or _by_number(files)
                grams, *block = (own.column(c).to_pylist() for c in ("gram", "n", "first", "numbers"))
                # Blocks of a bounded number of postings at a time.
                cuts = np.cumsum(block[0]) // RUN_POSTINGS_AT_ONCE
                for part in np.split(np.arange(len(grams)), np.flatnonzero(np.diff(cuts)) + 1):
                    a, b = int(part[0]), int(part[-1]) + 1
                    at, _ = decode(list(zip(*(c[a:b] for c in block))))
                    gram = np.repeat(np.arange(b - a), block[0][a:b])
                    place = names[0][at]
                    # Numbers of files that are gone are dropped.
                    gram, place = gram[place >= 0], pa.array(place[place >= 0])
                    found = [pa.array(grams[a:b]).take(pa.array(gram)), *(c.take(place) for c in names[1])]
                    yield pa.RecordBatch.from_arrays(found, schema=schema)

    return _by_run(index, FILE).mapInArrow(work, ddl)


# Postings that are named together.
RUN_POSTINGS_AT_ONCE = 1 << 18


def _by_number(files: list[pa.RecordBatch]) -> tuple[np.ndarray, list[pa.Array]]:
    """The row of each number of a run, -1 without a file, and the names by row."""
    place = np.full(RUN_FILES, -1, np.int64)
    at = np.concatenate([f.column("n").to_numpy() for f in files])
    place[at] = np.arange(len(at))
    return place, [pa.concat_arrays([f.column(c) for f in files]) for c in FILE]


def _by_run(index: GramIndex, names: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Files and blocks of a run one after the other in one task; rows of files have no gram, and their number in ``n``."""
    schema = arrow_schema(BLOCKS_DDL)
    files = index.files.selectExpr(
        "CAST(NULL AS STRING) AS gram", "run", "at AS n", "0 AS first", "0 AS last", "CAST(NULL AS BINARY) AS numbers", *names
    )
    blocks = index.blocks.select(*[f.name for f in schema], *[F.lit(None).cast("string").alias(c) for c in names])
    return files.unionByName(blocks).repartition("run").sortWithinPartitions("run", F.asc_nulls_first("gram"))


def _named(numbers: DataFrame, index: GramIndex) -> DataFrame:
    """Put the names of files onto their numbers; numbers of files that are gone are dropped."""
    return join_by_size(numbers, index.files.select("run", "at", *FILE), ["run", "at"], "inner")


def _combined(rows: DataFrame, keys: str, work: Callable[..., np.ndarray], *lists: str) -> DataFrame:
    """``(keys, run, at)``: the numbers that ``work`` makes of the lists of each row."""
    ddl = f"{keys}, run bigint, at int" if keys else "run bigint, at int"
    schema = arrow_schema(ddl)
    names = [f.name for f in schema][:-1]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = work(*(batch.column(c)[i].as_py() for c in lists))
                if len(at):
                    same = pa.array(np.zeros(len(at), np.int64) + i)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(same) for c in names), pa.array(at, pa.int32())], schema=schema
                    )

    return rows.select(*names, *lists).mapInArrow(combine, ddl)


def _common(blocks: list[dict], left: list[int] | None = None) -> np.ndarray:
    """Numbers that all blocks hold, and ``left`` if given."""
    # Bounds first: outside of the narrowest span no number is in all blocks.
    low, high = max(b["first"] for b in blocks), min(b["last"] for b in blocks)
    if low > high:
        return np.zeros(0, np.int64)
    at, _ = decode([(b["n"], b["first"], b["numbers"]) for b in blocks])
    # A block holds a number once, so the number of all blocks is in each.
    found = np.flatnonzero(np.bincount(at) == len(blocks))
    if left is not None:
        found = np.intersect1d(found, np.array(left, np.int64), assume_unique=True)
    return found


def _any(blocks: list[dict]) -> np.ndarray:
    """Numbers that some block holds."""
    return np.unique(decode([(b["n"], b["first"], b["numbers"]) for b in blocks])[0])


def demand_numbers(demand: Demand, grams: dict[str, list[str]], blocks: list[dict]) -> np.ndarray:
    """Numbers of the files of a run that fulfil a demand, from the blocks of its grams."""
    by_gram = {b["gram"]: b for b in blocks}
    if demand.kind == "text":
        wanted = grams[demand.text]
        if any(g not in by_gram for g in wanted):
            return np.zeros(0, np.int64)
        return _common([by_gram[g] for g in wanted])
    parts = [demand_numbers(p, grams, blocks) for p in demand.parts]
    join = np.intersect1d if demand.kind == "all" else np.union1d
    out = parts[0]
    for part in parts[1:]:
        out = join(out, part)
    return out


def files_with(index: GramIndex, demand: Demand, grams: dict[str, list[str]]) -> DataFrame:
    """Keys of the files that fulfil a demand, given the grams of its literals; only their blocks are read."""
    block = F.struct("gram", "n", "first", "last", "numbers")
    wanted = sorted({g for own in grams.values() for g in own})
    rows = index.blocks.where(F.col("gram").isin(wanted)).groupBy("run").agg(F.collect_list(block).alias("blocks"))
    found = _combined(rows, "", lambda blocks: demand_numbers(demand, grams, blocks), "blocks")
    return _named(found, index).select(*FILE)


# Grams that a query meets the index through before all others are looked at.
FIRST_GRAMS = 4


def common_files(index: GramIndex, wanted: DataFrame) -> DataFrame:
    """Files that hold every gram of a query: ``(query_id, repo, path)`` from ``(query_id, gram)``.

    The rarest grams of a query come first.  Of the others only those blocks are
    read that lie in a run where files are left and reach over their numbers;
    a run without a block of one of the grams drops out before any is decoded.
    """
    kind = f"query_id {wanted.schema['query_id'].dataType.simpleString()}"
    sizes = index.blocks.groupBy("gram").agg(F.sum("n").alias("n_files"))
    size = F.struct(F.coalesce("n_files", F.lit(0)).alias("n_files"), F.col("gram"))
    ranked = wanted.join(sizes, "gram", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(size)).alias("g"))
    # A gram that is nowhere ends its query.
    # Few bytes of queries are much work in blocks.
    ranked = spread(materialize(ranked, "ranked-grams")).where(F.col("g")[0]["n_files"] > 0)
    n_first = F.least(F.size("g"), F.lit(FIRST_GRAMS))
    first = ranked.select("query_id", n_first.alias("n_grams"), F.explode(F.slice("g", 1, FIRST_GRAMS)).alias("g"))
    met = first.select("query_id", "n_grams", "g.gram").join(index.blocks, "gram")
    rows = _grouped(met, "query_id", "run", "n_grams").where(F.size("blocks") == F.col("n_grams"))
    found = materialize(_combined(rows, kind, _common, "blocks"), "first-files")

    more = ranked.where(F.size("g") > FIRST_GRAMS)
    left = found.join(more.select("query_id"), "query_id", "left_semi")
    # The files that are left of a query in a run.
    left = materialize(
        left.groupBy("query_id", "run").agg(
            F.min("at").alias("low"), F.max("at").alias("high"), F.collect_list("at").alias("left")
        ),
        "left-files",
    ).withColumn("left", F.sort_array("left"))
    asked = more.select("query_id", F.slice("g", FIRST_GRAMS + 1, 1 << 30).alias("g")).select(
        "query_id", F.size("g").alias("n_grams"), F.explode("g.gram").alias("gram")
    )
    asked = asked.join(left.drop("left"), "query_id")
    met = asked.join(index.blocks, ["gram", "run"]).where(
        (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low"))
    )
    rows = _grouped(met, "query_id", "run", "n_grams").where(F.size("blocks") == F.col("n_grams"))
    rows = rows.join(left.select("query_id", "run", "left"), ["query_id", "run"])
    done = found.join(more.select("query_id"), "query_id", "left_anti")
    found = done.unionByName(_combined(rows, kind, _common, "blocks", "left"))
    return _named(found, index).select("query_id", *FILE)


def _grouped(met: DataFrame, *keys: str) -> DataFrame:
    """The blocks of each query in each run; a run has no more bytes of them than its postings."""
    return met.groupBy(*keys).agg(F.collect_list(F.struct("n", "first", "last", "numbers")).alias("blocks"))


def short_files(index: GramIndex, texts: DataFrame) -> DataFrame:
    """Files that contain a folded text shorter than a gram: ``(query_id, repo, path)`` from ``(query_id, text)``.

    Such a text lies in a gram, or the whole file is as short.  The result is exact.
    """
    kind = f"query_id {texts.schema['query_id'].dataType.simpleString()}"
    pieces = F.array_distinct(F.concat(*[ngrams(F.col("gram"), k) for k in range(1, index.n)]))
    known = index.blocks.select("gram").distinct().select("gram", F.explode(pieces).alias("text"))
    grams = texts.join(known, "text").select("query_id", "gram")
    rows = _grouped(grams.join(index.blocks, "gram"), "query_id", "run")
    found = _named(_combined(rows, kind, _any, "blocks"), index).select("query_id", *FILE)
    parts = F.array_distinct(F.concat(*[ngrams(F.col("short"), k) for k in range(1, index.n)]))
    small = index.files.where("short IS NOT NULL").select(*FILE, F.explode(parts).alias("text"))
    return found.unionByName(small.join(texts, "text").select("query_id", *FILE))


def live_blocks(index: GramIndex) -> DataFrame:
    """Blocks without the numbers of files that are gone.

    The rows of a run meet in order, its files ahead of its blocks, so a task
    holds the files of one run at a time.
    """
    schema = arrow_schema(BLOCKS_DDL)
    met = _by_run(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live = None, np.zeros(RUN_FILES, bool)
        for batch in batches:
            out = []
            for gram, run, n, first, _, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if run != current:
                    current, live = run, np.zeros(RUN_FILES, bool)
                if gram is None:
                    live[n] = True
                    continue
                at = decode([(n, first, numbers)])[0]
                at = at[live[at]]
                if len(at):
                    packed, _ = pack_numbers(np.diff(at))
                    out.append((gram, run, len(at), int(at[0]), int(at[-1]), packed.tobytes()))
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return met.mapInArrow(work, BLOCKS_DDL)
