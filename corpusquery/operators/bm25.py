"""Files ranked by BM25 from a word index whose blocks know the best they can hold.

Files are numbered in runs as in the n-gram index.  A word has one block per
run: numbers, occurrences, and beside them the highest number of occurrences
and the shortest file, which bound what any file of the run can score.  The most
promising runs are scored first; the score of the last ranked file then rules out
every run that cannot reach it, and the blocks of those are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.functions.folding import fold, fold_text
from corpusquery.operators import blocks as packed
from corpusquery.operators.lines import FILE
from corpusquery.operators.search import effective_limit
from corpusquery.plans.joins import join_by_size, materialize

# The usual parameters of the published formula.
K1 = 1.2
B = 0.75

# Runs that are scored before the others are compared with what they reach.
FIRST_RUNS = 64

# Digits that scores are rounded to, so that ties do not hang on the order of sums.
DIGITS = 6

WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class WordIndex:
    """Numbered files, runs with the lengths of their files, and blocks of words.

    ``files`` has ``(run, at, repo, path)``, ``runs`` ``(run, n_files, n_words,
    lengths)``, ``blocks`` ``(word, run, n, first, numbers, counts, most, least)``.
    """

    files: DataFrame
    runs: DataFrame
    blocks: DataFrame


_ROW = (
    "run bigint, at int, repo string, path string, n_files bigint, n_words bigint, lengths binary, "
    "word string, n int, first int, numbers binary, counts binary, most bigint, least bigint"
)


# Words of neighbouring files that are counted together.
SLICE_WORDS = 1 << 18


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of a bounded number of words, or of one file."""
    words = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum(words) // SLICE_WORDS
    for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(cuts)) + 1):
        if len(part):
            yield batch.slice(int(part[0]), len(part))


class _Found:
    """The distinct words of each of some files, and how often they occur."""

    def __init__(self, words: pa.ListArray):
        self.lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        self.dictionary = coded.dictionary
        n = max(1, len(self.dictionary))
        key = np.repeat(np.arange(len(words)), self.lengths) * n + coded.indices.to_numpy(zero_copy_only=False)
        key, self.counts = np.unique(key, return_counts=True)
        self.row, self.word = key // n, key % n
        # Postings up to and with each file.
        self.postings = np.cumsum(np.bincount(self.row, minlength=len(words)))


class _Run:
    """Postings of the files of a run while they are gathered, as numbers."""

    def __init__(self):
        self.names, self.lengths, self.known, self.parts = [], [], {}, []
        self.n_files = self.postings = 0

    def add(self, names: pa.RecordBatch, found: _Found, begin: int, end: int) -> None:
        own = slice(*np.searchsorted(found.row, [begin, end]))
        codes, place = np.unique(found.word[own], return_inverse=True)
        texts = found.dictionary.take(pa.array(codes)).to_pylist()
        ids = np.array([self.known.setdefault(w, len(self.known)) for w in texts], np.int32)
        at = (found.row[own] - begin + self.n_files).astype(np.int32)
        self.parts.append((ids[place], at, found.counts[own].astype(np.int32)))
        self.names.append(names)
        self.lengths.append(found.lengths[begin:end])
        self.n_files += end - begin
        self.postings += len(at)

    def blocks(self, number: int, sizes: np.ndarray) -> Iterator[dict]:
        """Columns of the blocks of words, some words at a time."""
        ids, at, counts = (np.concatenate(c) for c in zip(*self.parts))
        # Files come in order, so a stable sort leaves each block ascending.
        order = np.argsort(ids, kind="stable")
        ids, at, counts = ids[order], at[order], counts[order]
        begins = np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids))
        words = list(self.known)
        for i in range(0, len(words), 50_000):
            own = begins[i : i + 50_001]
            a, b, first = own[0], own[-1], own[:-1] - own[0]
            n, numbers, times = np.diff(own), at[a:b], counts[a:b]
            inner = np.ones(b - a, bool)
            inner[first] = False
            ends = np.cumsum(n)
            yield {
                "word": words[i : i + 50_000], "run": np.full(len(n), number), "n": n, "first": numbers[first],
                "numbers": packed.binaries(np.diff(numbers, prepend=0)[inner], ends - np.arange(1, len(n) + 1)),
                "counts": packed.binaries(times, ends),
                "most": np.maximum.reduceat(times, first), "least": np.minimum.reduceat(sizes[numbers], first),
            }


def build_word_index(files: DataFrame) -> WordIndex:
    """Index the folded words of files ``(repo, path, content)`` in one pass over the contents."""
    schema = packed.arrow_schema(_ROW)
    most_files, most_postings = packed.RUN_FILES, packed.RUN_POSTINGS

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def flush(number: int, run: _Run) -> Iterator[pa.RecordBatch]:
        if not run.n_files:
            return
        repos, paths = (pa.concat_arrays([p.column(c) for p in run.names]) for c in FILE)
        yield rows_of(run=np.full(run.n_files, number), at=np.arange(run.n_files), repo=repos, path=paths)
        sizes = np.concatenate(run.lengths).astype("<u4")
        total = int(sizes.sum(dtype=np.int64))
        yield rows_of(run=[number], n_files=[run.n_files], n_words=[total], lengths=[sizes.tobytes()])
        if run.postings:
            yield from (rows_of(**part) for part in run.blocks(number, sizes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, run = TaskContext.get().partitionId() << 16, _Run()
        for batch in batches:
            for rows in _slices(batch):
                found = _Found(rows.column("words"))
                begin = 0
                while begin < rows.num_rows:
                    room = np.searchsorted(found.postings - (found.postings[begin - 1] if begin else 0), most_postings - run.postings)
                    end = min(rows.num_rows, max(begin, int(room)) + 1, begin + most_files - run.n_files)
                    run.add(rows.slice(begin, end - begin).select(FILE), found, begin, end)
                    if run.n_files >= most_files or run.postings >= most_postings:
                        yield from flush(number, run)
                        number, run = number + 1, _Run()
                    begin = end
        yield from flush(number, run)

    text = F.regexp_extract_all(fold(F.col("content")), F.lit(WORD), F.lit(0))
    built = materialize(files.select(*FILE, text.alias("words")).mapInArrow(work, _ROW), "word-index")
    return WordIndex(
        built.where("at IS NOT NULL").select("run", "at", *FILE),
        built.where("lengths IS NOT NULL").select("run", "n_files", "n_words", "lengths"),
        built.where("word IS NOT NULL").select("word", "run", "n", "first", "numbers", "counts", "most", "least"),
    )


def _share(occurrences, length, average):
    """What a word adds to a score per unit of its weight."""
    return occurrences * (K1 + 1) / (occurrences + K1 * (1 - B + B * length / average))


def reachable(bounds: DataFrame, least: float, done: list[int]) -> DataFrame:
    """Runs that are not done and may hold a file with a score of ``least``."""
    return bounds.where((F.col("bound") >= least) & ~F.col("run").isin(done)).select("run")


def top_files_bm25(index: WordIndex, words: list[str], limit: int | None = 0) -> DataFrame:
    """The best files for a list of words: ``(repo, path, score)``, best first.

    Words are folded; repeated and unknown ones count once and not at all.  Files
    without any of the words are left out.  ``limit`` 0 means 50, and there is
    always one.
    """
    k = effective_limit(limit) or effective_limit(0)
    asked = sorted({fold_text(w) for w in words})
    own = index.blocks.where(F.col("word").isin(asked))
    total = index.runs.agg(F.sum("n_files").alias("files"), F.sum("n_words").alias("words")).first()
    n_files, average = total["files"] or 0, max(1.0, (total["words"] or 0) / max(1, total["files"] or 0))
    found = {r["word"]: r["df"] for r in own.groupBy("word").agg(F.sum("n").alias("df")).collect()}
    weights = {w: math.log(1 + (n_files - df + 0.5) / (df + 0.5)) for w, df in found.items()}
    weight = F.lit(0.0)
    for word, value in weights.items():
        weight = F.when(F.col("word") == word, value).otherwise(weight)
    share: Column = _share(F.col("most"), F.col("least"), F.lit(average))
    bounds = materialize(own.groupBy("run").agg(F.sum(weight * share).alias("bound")), "run-bounds")

    first = [r["run"] for r in bounds.orderBy(F.desc("bound"), "run").limit(FIRST_RUNS).collect()]
    best = materialize(_scored(index, own.where(F.col("run").isin(first)), weights, average, k), "first-scores")
    kth = best.orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
    least = kth["s"] if kth["n"] == k else 0.0
    left = materialize(reachable(bounds, least - 10**-DIGITS, first), "reachable-runs")
    if not left.isEmpty():
        more = join_by_size(own, left, ["run"], "left_semi", spread_by=["word"])
        best = best.unionByName(_scored(index, more, weights, average, k))
    # Ties at the end are broken by name, so names come before the cut.
    near = best.where(F.col("score") >= least)
    named = join_by_size(near, index.files, ["run", "at"], "inner")
    return named.select(*FILE, "score").orderBy(F.desc("score"), *FILE).limit(k)


def _scored(index: WordIndex, own: DataFrame, weights: dict[str, float], average: float, k: int) -> DataFrame:
    """``(run, at, score)`` of the best files of each run, ties with the last one included."""
    ddl = "run bigint, at int, score double"
    schema = packed.arrow_schema(ddl)
    block = F.struct("word", "n", "first", "numbers", "counts")
    rows = own.groupBy("run").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    rows = rows.join(index.runs.select("run", "lengths"), "run")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, blocks, lengths in zip(*(batch.column(c).to_pylist() for c in ("run", "blocks", "lengths"))):
                sizes = np.frombuffer(lengths, "<u4").astype(float)
                scores = np.zeros(len(sizes))
                for b in blocks:
                    at, _ = packed.decode([(b["n"], b["first"], b["numbers"])])
                    counts = packed.unpack_numbers(b["counts"]).astype(float)
                    scores[at] += weights[b["word"]] * _share(counts, sizes[at], average)
                scores = np.round(scores, DIGITS)
                last = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
                kept = np.flatnonzero((scores >= last) & (scores > 0))
                columns = [pa.array(np.full(len(kept), run)), pa.array(kept, pa.int32()), pa.array(scores[kept])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("run", "blocks", "lengths").mapInArrow(work, ddl)
