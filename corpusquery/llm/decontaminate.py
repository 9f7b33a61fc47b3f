"""Benchmark items found in documents by a prefix-filtered join of word shingles."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusquery.llm.arrow import append_columns, own_columns, strings
from corpusquery.plans.joins import materialize

WINDOW = 13
SHINGLE = 5

# Text of benchmark items that is compared at a time.  More text than this is
# compared in blocks of items, one pass over the documents for each.
BLOCK_BYTES = 2 << 20

# Bytes that are no part of a word become spaces, capitals small letters.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of small letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def _shingle_keys(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of each run of ``length`` word numbers."""
    keys = np.zeros(ids.size - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            keys += (ids[k : ids.size - length + 1 + k].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[k]
        keys ^= keys >> np.uint64(29)
        return keys * _WEIGHTS[0]


@dataclass
class Block:
    """Windows of a block of benchmark items, as shingles of numbered words."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    # Shingles are numbered; by length: sorted keys, the numbers and the words behind them.
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    # Window: number of words, shingles in order, names of the items that hold it.
    windows: list[tuple[int, list[int], list[str]]] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[str, str]]) -> Block:
        block, numbers = cls(), {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            words = [block.vocabulary.setdefault(w, len(block.vocabulary)) for w in words_of(text)]
            length = min(WINDOW, len(words))
            for at in range(len(words) - length + 1 if words else 0):
                owners[tuple(words[at : at + length])].add(name)
        for window, names in owners.items():
            q = min(SHINGLE, len(window))
            shingles = [
                numbers.setdefault(window[k : k + q], len(numbers)) for k in range(len(window) - q + 1)
            ]
            block.windows.append((len(window), shingles, sorted(names)))
        for q in {len(s) for s in numbers}:
            own = [s for s in numbers if len(s) == q]
            words = np.array(own, np.int64).reshape(-1, q)
            keys = np.array([_shingle_keys(w, q)[0] for w in words], np.uint64)
            order = np.argsort(keys)
            block.tables[q] = keys[order], np.array([numbers[s] for s in own], np.int32)[order], words[order]
        return block

    def occurrences(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and places of all shingles of the block among words, compared exactly."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        found, places = [], []
        for q, (keys, numbers, shingles) in self.tables.items():
            if ids.size < q:
                continue
            unknown = np.concatenate(([0], np.cumsum(ids < 0)))
            at = np.flatnonzero(unknown[q:] == unknown[:-q])
            if not at.size:
                continue
            wanted = _shingle_keys(ids, q)[at]
            lo = np.searchsorted(keys, wanted, "left")
            # Different shingles of one key are rare; all of them are compared.
            while True:
                near = np.minimum(lo, keys.size - 1)
                same = (lo < keys.size) & (keys[near] == wanted)
                at, wanted, lo, near = at[same], wanted[same], lo[same], near[same]
                if not at.size:
                    break
                equal = (shingles[near] == ids[at[:, None] + np.arange(q)]).all(axis=1)
                found.append(numbers[near[equal]])
                places.append(at[equal])
                lo = lo + 1
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(places)

    def anchors(self, counts: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """By shingle: the windows whose rarest shingle it is, and its place in them.

        A window is contained as a whole, so one shingle is all the prefix it
        needs, and the rarest one gives the fewest candidates.
        """
        out = defaultdict(list)
        for number, (_, shingles, _) in enumerate(self.windows):
            place = min(range(len(shingles)), key=lambda k: (counts.get(shingles[k], 0), shingles[k], k))
            out[shingles[place]].append((number, place))
        return dict(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contained_windows(
    block: Block, anchors: dict[int, list[tuple[int, int]]], n_words: int, shingles: list[int], places: list[int]
) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words inside a window of the block, and the items of these windows."""
    spans, items, there = [], set(), None
    for shingle, place in zip(shingles, places):
        for number, offset in anchors.get(shingle, ()):
            length, own, names = block.windows[number]
            start = place - offset
            if start < 0 or start + length > n_words:
                continue
            if there is None:
                there = set(zip(places, shingles))
            if all((start + k, s) in there for k, s in enumerate(own)):
                spans.append((start, start + length))
                items.update(names)
    return spans, items


_STATE = "_spans array<struct<a:bigint,b:bigint>>, _items array<string>"
_FOUND = "_n_words bigint, _shingles array<int>, _places array<bigint>"
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _find_shingles(docs: DataFrame, block, keep_text: bool) -> DataFrame:
    def make():
        known = block.value

        def columns(batch):
            n, shingles, places = [], [], []
            for text in strings(batch.column("text")):
                words = words_of(text)
                s, p = known.occurrences(words)
                n.append(len(words))
                shingles.append(s)
                places.append(p)
            return [n, shingles, places]

        return columns

    return append_columns(docs, "text", _FOUND, make, drop=() if keep_text else ("text",))


def _verify(found: DataFrame, block, anchors) -> DataFrame:
    def make():
        known, prefix = block.value, anchors.value

        def columns(batch):
            spans, items = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("_n_words", "_shingles", "_places", "_spans", "_items")))
            for n, shingles, places, old_spans, old_items in rows:
                new_spans, new_items = contained_windows(known, prefix, n, shingles, places)
                old = [(x["a"], x["b"]) for x in old_spans]
                spans.append([{"a": a, "b": b} for a, b in _merged(old + new_spans)])
                items.append(sorted(new_items.union(old_items)))
            return [spans, items]

        return columns

    return append_columns(found, "_shingles", _STATE, make, drop=("_shingles", "_places"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``BLOCK_BYTES``, each small enough for the driver."""
    named = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("string").alias("name"), F.col("text")
    )
    total = named.agg(F.coalesce(F.sum(F.octet_length("text") + 20), F.lit(0))).first()[0]
    count = max(1, math.ceil(total / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(count))
    for k in range(count):
        yield [(r["name"], r["text"]) for r in named.where(part == k).collect()], k + 1 == count


def contamination(docs: DataFrame, items: DataFrame, keep_text: bool = False) -> DataFrame:
    """Add how much of each document lies in windows of benchmark items.

    ``docs`` has ``text``, ``items`` has ``item_id`` and ``text``.  Words are
    runs of letters a-z, digits and non-ASCII characters, A-Z lower-cased.  A
    window is 13 consecutive words of an item, or all words of a shorter one.
    New columns: ``n_words``; ``n_hit``, the words inside any occurrence of a
    window; ``n_items`` with an occurring window; ``items_sha256`` of their ids,
    sorted as strings and joined by commas; ``contaminated``, if at least one
    word in twenty is hit.  ``hit_spans`` and ``hit_items`` name them.

    Every document is searched for the five-word shingles of the items, whose
    counts over all documents give their rarity.  A window meets a document
    only through its rarest shingle; candidates outside the document are
    dropped, the others verified shingle by shingle.  All of this happens
    within the row, so no word of a document is shuffled.  Items are compared
    in blocks of bounded size, and only a block is ever sent to the tasks.

    Null or empty texts have no words; items without id or words are ignored;
    items that share an id count once.  Repeated documents are judged alike and
    all returned.  Other columns stay, but those named like a result are
    replaced, and ``text`` only stays with ``keep_text``.
    """
    context = docs.sparkSession.sparkContext
    kept, own = own_columns(docs, {*RESULT, "hit_spans", "hit_items", "text"})
    state = docs.select(
        own.alias("own"),
        F.col("text").alias("text"),
        F.expr("CAST(array() AS array<struct<a:bigint,b:bigint>>)").alias("_spans"),
        F.expr("CAST(array() AS array<string>)").alias("_items"),
    )
    for rows, last in _blocks(items):
        block = context.broadcast(Block.build(rows))
        found = materialize(_find_shingles(state, block, keep_text or not last), "shingles")
        # At most one row per shingle of the block.
        counts = found.select(F.explode("_shingles").alias("s")).groupBy("s").count().collect()
        anchors = context.broadcast(block.value.anchors({r["s"]: r["count"] for r in counts}))
        state = _verify(found, block, anchors)
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"])
    return (
        state.withColumn("n_hit", hit)
        .select(
            *[F.col("own").getField(c).alias(c) for c in kept],
            *(["text"] if keep_text else []),
            F.col("_n_words").alias("n_words"),
            "n_hit",
            F.size("_items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("_n_words"))).alias("contaminated"),
            F.col("_spans").alias("hit_spans"),
            F.col("_items").alias("hit_items"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are not contaminated, in their own columns."""
    _, own = own_columns(docs, {"text"})
    packed = docs.select(own.alias("document"), F.col("text").alias("text"))
    judged = contamination(packed, items, keep_text=True).where("NOT contaminated")
    column = lambda c: F.col("text") if c.lower() == "text" else F.col("document").getField(c)
    return judged.select(*[column(c).alias(c) for c in docs.columns])
