"""Packing of token sequences by a grouping genetic algorithm.

A solution is a set of bins.  Crossover takes whole well-filled bins of one
parent into the other, removes the bins of the other that hold any of the same
pieces, and puts what is displaced back by best fit, longest first.

Pieces are dealt into decks of bounded size.  Several islands evolve a
population for each deck, and between epochs the best solution of an island
migrates to its neighbour.  The emptiest bins of the best solution are then
opened, and their pieces go into the decks of the next round, until one deck is
left; so the space that decks cannot fill on their own is shared in the end.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusquery.llm.arrow import append_columns, arrow_schema
from corpusquery.llm.byte_bpe import byte_characters, load_tokenizer
from corpusquery.plans.joins import materialize

# Pieces of a deck, islands per deck, solutions of an island.
DECK = 2048
ISLANDS = 3
POPULATION = 4

# Epochs between which the best solutions migrate, and children of an epoch.
EPOCHS = 3
CHILDREN = 6

# Islands that a task works on.
ROWS_PER_TASK = 64

# Share of the bins of a solution that are opened for the next round, and their least number.
OPENED = 1 / 16
LEAST_OPENED = 8

# Chunks whose ids a worker remembers.
REMEMBERED_CHUNKS = 1_000_000
MAX_REMEMBERED_LENGTH = 48


# A word of letters that are one character in every normal form, as they are in
# lower case, between marks that never join letters.
WORD = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder(dict):
    """Ids of texts for a vocabulary that folds case, splits at white space and ignores it.

    No token reaches over a space or line end, so the distinct chunks between
    them are looked up, and the marks around a word apart from it.  A plain word
    is one piece for the merges of the library and skips the rest of it.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_characters()

    def __missing__(self, chunk: str) -> bytes:
        parts = WORD.fullmatch(chunk)
        if parts is None:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        elif len(parts[2]) < len(chunk):
            ids = b"".join([self[p] for p in parts.groups() if p])
        else:
            word = chunk.lower()
            if not word.isascii():
                word = "".join([self.letters[b] for b in word.encode()])
            ids = array("I", [t.id for t in self.merge(word)]).tobytes()
        if len(chunk) <= MAX_REMEMBERED_LENGTH:
            self[chunk] = ids
        return ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, 32 bits each, and where each text ends."""
        if len(self) > REMEMBERED_CHUNKS:
            self.clear()
        even = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        chunks = pc.split_pattern(even, " ")
        coded = chunks.flatten().dictionary_encode()
        known = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        own = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, place = np.frombuffer(b"".join(known), "<u4"), coded.indices.to_numpy()
        sizes = own[place]
        ends = np.cumsum(sizes)
        # The ids of a chunk stand one after the other, wherever it occurs.
        source = np.repeat((np.cumsum(own) - own)[place] - (ends - sizes), sizes)
        ids = flat[source + np.arange(len(source))]
        stops = np.cumsum(chunks.value_lengths().to_numpy())
        return ids, np.concatenate([[0], ends])[stops]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``(doc_id, piece, start, length, ids)``.

    ``ids`` is binary, 32 bits a token, little-endian.  Each document ends with
    ``end_id``; a null or empty text is that id alone.  Only longer documents are
    cut, and their last piece may be shorter.
    """

    def make():
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity

        def columns(batch):
            ids, ends = encode(batch.column("text"))
            cut = []
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                raw = ids[a:b].tobytes() + end
                cut.append([raw[at : at + step] for at in range(0, len(raw), step)])
            return [pa.array(cut, pa.list_(pa.binary()))]

        return columns

    cut = append_columns(docs.select("doc_id", "text"), "text", "pieces array<binary>", make, drop=("text",))
    return cut.select("doc_id", F.posexplode("pieces").alias("piece", "ids")).select(
        "doc_id",
        "piece",
        (F.col("piece").cast("bigint") * capacity).alias("start"),
        (F.octet_length("ids") / 4).cast("bigint").alias("length"),
        "ids",
    )


class Shelf:
    """Open bins by the space that is left in them, for best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.spaces, self.by_space = capacity, 0, {}

    def put(self, bin_: int, space: int) -> None:
        if space:
            self.by_space.setdefault(space, []).append(bin_)
            self.spaces |= 1 << space

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with least space that still holds ``length``, and its space."""
        fitting = self.spaces >> length
        if not fitting:
            return None
        space = length + (fitting & -fitting).bit_length() - 1
        bins = self.by_space[space]
        bin_ = bins.pop()
        if not bins:
            self.spaces ^= 1 << space
        return bin_, space


def best_fit(lengths: list[int], order, bins: np.ndarray, n_bins: int, shelf: Shelf) -> int:
    """Put the pieces of ``order`` where they fit best, into new bins if need be; the number of bins."""
    for i in order:
        length = lengths[i]
        found = shelf.take(length)
        if found is None:
            found = n_bins, shelf.capacity
            n_bins += 1
        bins[i] = found[0]
        shelf.put(found[0], found[1] - length)
    return n_bins


class Solution:
    """A bin for each piece; better ones have fewer bins, then fuller ones."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.bins = bins
        self.fill = np.bincount(bins, lengths).astype(np.int64)
        fullness = float(((self.fill / capacity) ** 2).sum())
        self.rank = (len(self.fill), -fullness)


def cross(
    lengths: np.ndarray, giver: Solution, taker: Solution, capacity: int, chance: random.Random
) -> Solution:
    """A child of two solutions that has whole bins of the first."""
    fullest = np.argsort(-giver.fill, kind="stable")
    well_filled = fullest[: max(1, len(fullest) // 2)]
    wanted = max(1, chance.randint(1, max(1, len(well_filled) // 4)))
    chosen = np.zeros(len(giver.fill), bool)
    chosen[chance.sample(well_filled.tolist(), min(wanted, len(well_filled)))] = True
    injected = chosen[giver.bins]

    # Bins that hold an injected piece go, and now and then some of the emptiest as well.
    broken = np.zeros(len(taker.fill), bool)
    broken[taker.bins[injected]] = True
    emptiest = np.argsort(taker.fill, kind="stable")
    broken[emptiest[: chance.randint(0, 3)]] = True
    displaced = broken[taker.bins] & ~injected

    bins = np.full(len(lengths), -1, np.int64)
    stay = np.cumsum(~broken) - 1
    left = ~displaced & ~injected
    bins[left] = stay[taker.bins[left]]
    n_bins = int((~broken).sum())
    given = np.cumsum(chosen) - 1 + n_bins
    bins[injected] = given[giver.bins[injected]]
    n_bins += int(chosen.sum())

    shelf = Shelf(capacity)
    fill = np.bincount(bins[bins >= 0], lengths[bins >= 0], minlength=n_bins).astype(int)
    for bin_ in np.flatnonzero(fill < capacity).tolist():
        shelf.put(bin_, capacity - int(fill[bin_]))
    out = np.flatnonzero(displaced)
    longest_first = out[np.argsort(-lengths[out], kind="stable")]
    best_fit(lengths.tolist(), longest_first.tolist(), bins, n_bins, shelf)
    return Solution(lengths, bins, capacity)


def founders(lengths: np.ndarray, capacity: int, chance: random.Random) -> list[Solution]:
    """First solutions: best fit, longest first, and with orders that are shaken a little."""
    found = []
    for k in range(POPULATION):
        shaken = [n * (1 + 0.25 * k * (chance.random() - 0.5)) for n in lengths.tolist()]
        order = sorted(range(len(lengths)), key=lambda i: -shaken[i])
        bins = np.zeros(len(lengths), np.int64)
        best_fit(lengths.tolist(), order, bins, 0, Shelf(capacity))
        found.append(Solution(lengths, bins, capacity))
    return found


def evolve(
    lengths: np.ndarray, population: list[Solution], capacity: int, chance: random.Random
) -> list[Solution]:
    """One epoch of an island, best solution first."""
    population = sorted(population, key=lambda s: s.rank)[:POPULATION]
    for _ in range(CHILDREN):
        # Nothing is left to gain when all bins but one are full.
        best = population[0]
        if (best.fill < capacity).sum() <= 1:
            break
        giver, taker = sorted(chance.sample(range(len(population)), 2)) if len(population) > 1 else (0, 0)
        child = cross(lengths, population[giver], population[taker], capacity, chance)
        if child.rank < population[-1].rank or len(population) < POPULATION:
            population = sorted([*population, child], key=lambda s: s.rank)[:POPULATION]
    return population


PLACED = "uid bigint, length bigint, deck bigint, bin bigint, offset bigint, open boolean"
STATE = "deck bigint, island int, lengths binary, genomes array<binary>, n_bins int, fullness double"


def _epoch(epoch: int, round_: int, capacity: int):
    """Work of one epoch on rows ``(deck, island, lengths, genomes)``; the first one founds the islands."""

    schema = arrow_schema(STATE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deck, island, raw, genomes in zip(
                *(batch.column(c).to_pylist() for c in ("deck", "island", "lengths", "genomes"))
            ):
                # The same numbers again if the task is repeated.
                chance = random.Random(f"{round_}/{epoch}/{deck}/{island}")
                lengths = np.frombuffer(raw, "<u4").astype(np.int64)
                if genomes:
                    population = [
                        Solution(lengths, np.frombuffer(g, "<u4").astype(np.int64), capacity) for g in genomes
                    ]
                else:
                    population = founders(lengths, capacity, chance)
                population = evolve(lengths, population, capacity, chance)
                n_bins, fullness = population[0].rank
                out = [[s.bins.astype("<u4").tobytes() for s in population]]
                row = [[deck], [island], [raw], out, [n_bins], [-fullness]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    return work


def _settle(last: bool, capacity: int):
    """Places of the pieces of decks ``(deck, uids, lengths, genome)``; opened bins have none."""

    schema = arrow_schema(PLACED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deck, uids, raw, genome in zip(
                *(batch.column(c).to_pylist() for c in ("deck", "uids", "lengths", "genome"))
            ):
                lengths = np.frombuffer(raw, "<u4").astype(np.int64)
                best = Solution(lengths, np.frombuffer(genome, "<u4").astype(np.int64), capacity)
                order = np.argsort(best.bins, kind="stable")
                ends = np.cumsum(lengths[order])
                offset = np.empty_like(lengths)
                filled = np.cumsum(best.fill) - best.fill
                offset[order] = ends - lengths[order] - filled[best.bins[order]]
                opened = np.zeros(len(best.fill), bool)
                if not last:
                    emptiest = np.argsort(best.fill, kind="stable")
                    emptiest = emptiest[: max(LEAST_OPENED, int(OPENED * len(emptiest)))]
                    opened[emptiest[best.fill[emptiest] < capacity]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uids, pa.int64()),
                        pa.array(lengths),
                        pa.array(np.full(len(lengths), deck)),
                        pa.array(best.bins),
                        pa.array(offset),
                        pa.array(opened[best.bins]),
                    ],
                    schema=schema,
                )

    return work


@dataclass
class Packing:
    """Pieces ``(uid, doc_id, piece, start, length, ids)`` and places ``(uid, sequence_id, offset)``."""

    pieces: DataFrame
    places: DataFrame

    def sequences(self) -> DataFrame:
        """Whole sequences ``(sequence_id, length, ids)``, at most ``capacity`` tokens each."""
        placed = self.pieces.select("uid", "length", "ids").join(self.places, "uid")
        parts = placed.groupBy("sequence_id").agg(
            F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
        )
        joined = F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
        return parts.select("sequence_id", "length", joined.alias("ids"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Places ``(uid, sequence_id, offset)`` of pieces ``(uid, length)`` in sequences of ``capacity``.

    Pieces of full length are sequences of their own, with numbers below 0.  An
    empty table has no places.
    """
    full = pieces.where(F.col("length") == capacity)
    placed = [full.select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    left, round_ = pieces.where(F.col("length") < capacity).select("uid", "length"), 0
    n = left.count()
    while n:
        decks = max(1, math.ceil(n / DECK))
        settled = materialize(_round(left, decks, round_, capacity), f"packed-{round_}")
        number = F.lit(round_ << 56) + F.col("deck") * F.lit(1 << 24) + F.col("bin")
        placed.append(settled.where("NOT open").select("uid", number.alias("sequence_id"), "offset"))
        left, round_ = settled.where("open").select("uid", "length"), round_ + 1
        n = left.count() if decks > 1 else 0
    return reduce(DataFrame.unionByName, placed)


def _round(left: DataFrame, decks: int, round_: int, capacity: int) -> DataFrame:
    dealt = left.groupBy(F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(decks)).alias("deck")).agg(
        F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("hand")
    )
    hands = materialize(dealt.select("deck", F.col("hand.uid").alias("uids"), F.col("hand.length").alias("n")), "hands")

    def as_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(x, "<u4").tobytes() for x in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("deck"), pa.array(raw, pa.binary())], names=["deck", "lengths"]
            )

    lengths = hands.select("deck", "n").mapInArrow(as_binary, "deck bigint, lengths binary")
    state = lengths.select(
        "deck",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        "lengths",
        F.lit(None).cast("array<binary>").alias("genomes"),
    )
    # A row is work for a fraction of a second, far more than its bytes tell.
    rows = decks * ISLANDS
    tasks = max(math.ceil(rows / ROWS_PER_TASK), min(rows, left.sparkSession.sparkContext.defaultParallelism))
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select(
                "deck",
                F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                F.element_at("genomes", 1).alias("immigrant"),
            )
            met = state.select("deck", "island", "lengths", "genomes").join(elite, ["deck", "island"])
            state = met.withColumn("genomes", F.concat("genomes", F.array("immigrant"))).drop("immigrant")
        state = state.repartition(tasks, "deck", "island")
        state = materialize(state.mapInArrow(_epoch(epoch, round_, capacity), STATE), f"islands-{round_}-{epoch}")
    rank = F.struct(-F.col("n_bins"), F.col("fullness"), -F.col("island"))
    best = state.groupBy("deck").agg(
        F.max_by(F.struct("lengths", F.element_at("genomes", 1).alias("genome")), rank).alias("best")
    )
    rows = hands.select("deck", "uids").join(best.select("deck", "best.*"), "deck")
    return rows.mapInArrow(_settle(decks == 1, capacity), PLACED)


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int) -> Packing:
    """Encode every ``text`` of ``(doc_id, text)`` and pack the pieces into few sequences.

    ``path`` is a tokenizer file whose tokens never reach over white space;
    every executor must have it.  A null or empty text is ``end_id`` alone.
    Repeated rows are packed each, and null ids stay null.  Other columns are
    ignored.  An empty table gives no pieces.
    """
    pieces = token_pieces(docs, path, end_id, capacity).withColumn("uid", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    return Packing(pieces, pack(pieces.select("uid", "length"), capacity))
