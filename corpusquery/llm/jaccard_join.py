"""Exact similarity join of documents by their word shingles, in size-banded tiles.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is at least 0.8.  The steps:

1.  Every text becomes a set of 64-bit shingle keys.  Texts with equal sets
    form a class and go on as one.
2.  The shingles of all sets are put in one order.  Two shingles that follow each
    other in both of two sets are a common step.  A shingle that only one set has
    breaks at most two steps of its own set and one of the other; so with a
    similarity of 0.8, among the first two fifths (plus one) of the steps of
    either set one is common.  Unrelated texts share single shingles, but hardly
    a step.  Shingles that a sample of rows shows to be frequent come last in the
    order, which keeps common passages apart; the order changes only the work,
    never the result.
3.  Sets that share such a step are joined to clusters through the smallest
    set of each step, never pairwise.
4.  The sets of a cluster are cut into tiles of bounded size: by bands of set size, as
    linked sets differ by a quarter at most, and by blocks within a band.  In
    a tile, hashed bitmaps bound the overlap from above by their differing
    bits; only pairs within the bound are intersected, and no pair that is
    linked already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.llm.arrow import append_columns, arrow_schema, strings
from corpusquery.llm.components import connected_components, join_counted
from corpusquery.plans.joins import join_by_size, materialize

SHINGLE = 5
# Similarity of at least 80 / 100.
PERCENT = 80

# Share of rows that frequent shingles are looked for in, one in so many; the
# number of rows of the sample that make a shingle frequent; and how many of
# the most frequent are remembered.  They only order shingles.
SAMPLE = 16
FREQUENT = 4
MAX_FREQUENT = 200_000

# Shingles of one block of a tile.
BLOCK_SHINGLES = 2_000_000
# Sets of a cluster that every block of it is compared with first.
LEADERS = 8

REMEMBERED_WORDS = 100_000
# Names of sets that a task remembers, so that copies leave out their steps.
REMEMBERED_SETS = 100_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# Odd constants that keep the places of the words of a shingle apart.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordKeys(dict):
    def __missing__(self, word: bytes) -> int:
        key = self[word] = xxhash.xxh3_64_intdigest(word)
        return key


class Shingler:
    """Sorted shingle keys of texts."""

    def __init__(self) -> None:
        self.words = _WordKeys()

    def keys(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < SHINGLE:
            # One shingle of fewer words; the length keeps it apart from others.
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        own = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = own.size - SHINGLE + 1
        with np.errstate(over="ignore"):
            keys = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                keys = (keys ^ own[k : k + n]) * _PLACES[k]
                keys ^= keys >> np.uint64(32)
        return np.unique(keys)


def prefix_steps(n: int) -> int:
    """Steps of a set of which any linked set has one among its own first ones.

    With a shingles only here and b only there, 2a + b steps can be broken.  A
    similarity of 0.8 allows a = 0.2 n with b = 0, the worst case, or less of
    a for 1.25 times as much of b.
    """
    return 2 * (100 - PERCENT) * n // 100 + 1


def steps(keys: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first steps of a set: those that start at a rare shingle, and the others."""
    at = np.minimum(np.searchsorted(frequent, keys), max(0, frequent.size - 1))
    often = frequent[at] == keys if frequent.size else np.zeros(keys.size, bool)
    rare = keys[~often]
    ordered = np.concatenate((rare, keys[often]))[: prefix_steps(keys.size) + 1]
    with np.errstate(over="ignore"):
        hashes = (ordered[:-1] * _PLACES[0]) ^ (ordered[1:] * _PLACES[1])
        hashes = ((hashes ^ (hashes >> np.uint64(31))) * _PLACES[2]).view(np.int64)
    return hashes[: rare.size], hashes[rare.size :]


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _set_name(keys: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set apart, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(keys.tobytes())
    return tuple(np.frombuffer(digest, "<i8").tolist())


def _keys_of(batch: pa.RecordBatch, shingler: Shingler) -> list[np.ndarray]:
    return [shingler.keys(t).view(np.int64) for t in strings(batch.column("text"))]


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted keys of the shingles that most rows of a sample hold, at most ``MAX_FREQUENT``."""
    chosen = docs.where(F.pmod("row", F.lit(SAMPLE)) == 0).select("text")

    def make():
        shingler = Shingler()
        return lambda batch: [_keys_of(batch, shingler)]

    found = append_columns(chosen, "text", "keys array<bigint>", make, drop=("text",))
    counts = found.select(F.explode("keys").alias("key")).groupBy("key").count()
    counts = materialize(counts.where(F.col("count") >= FREQUENT), "frequent-shingles")
    # The lowest count whose shingles are still few enough to be sent to every task.
    left, least = MAX_FREQUENT, None
    for row in counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).collect():
        left -= row["n"]
        if left < 0:
            break
        least = row["count"]
    if least is None:
        return np.zeros(0, np.uint64)
    found = counts.where(F.col("count") >= least).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, frequent) -> DataFrame:
    """Replace ``text`` by ``n_shingles``, the name ``key, key2`` of its set (null when empty) and its steps.

    The first steps of a set are ``rare`` and ``often``, arrays of hashes.  Of
    equal sets that a task meets, the first one has them and the others have none.
    """

    def make():
        shingler, known, seen = Shingler(), frequent.value, set()
        none = (np.zeros(0, np.int64),) * 2

        def first(name):
            if name in seen:
                return False
            if len(seen) >= REMEMBERED_SETS:
                seen.clear()
            seen.add(name)
            return True

        def columns(batch):
            sets = [shingler.keys(t) for t in strings(batch.column("text"))]
            names = [_set_name(s) if s.size else (None, None) for s in sets]
            found = [steps(s, known) if s.size and first(n) else none for s, n in zip(sets, names)]
            return [
                [s.size for s in sets],
                *([n[k] for n in names] for k in (0, 1)),
                *([f[k] for f in found] for k in (0, 1)),
            ]

        return columns

    ddl = "n_shingles bigint, key bigint, key2 bigint, rare array<bigint>, often array<bigint>"
    return append_columns(docs, "text", ddl, make, drop=("text",))


def _candidates(sets: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` from each set to the smallest set that shares a step with it."""
    schema = arrow_schema("a bigint, b bigint")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = leader = None
        for batch in batches:
            own, keys = batch.column("step").to_numpy(), batch.column("set_key").to_numpy()
            if not own.size:
                continue
            first = np.concatenate(([own[0] != step], own[1:] != own[:-1]))
            at = np.maximum.accumulate(np.where(first, np.arange(own.size), -1))
            leaders = np.where(at >= 0, keys[np.maximum(at, 0)], 0 if leader is None else leader)
            step, leader = own[-1], leaders[-1]
            pairs = np.unique(np.stack([keys, leaders], axis=1)[keys != leaders], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    # Few sets have a step with a rare shingle, so they meet in its partition;
    # nothing is listed.
    rare = sets.select(F.explode("rare").alias("step"), "set_key").repartition("step")
    met = rare.sortWithinPartitions("step", "set_key").mapInArrow(stars, "a bigint, b bigint")
    # Very many sets may have another step: their minimum is combined before the
    # shuffle, and what comes back is broadcast or salted.
    often = sets.select(F.explode("often").alias("step"), "set_key")
    least = often.groupBy("step").agg(F.min("set_key").alias("b"), F.max("set_key").alias("_high"))
    least = materialize(least.where("b <> _high").drop("_high"), "common-steps")
    joined = join_by_size(often, least, ["step"], "inner", spread_by=["set_key"]).where("set_key <> b")
    return met.unionByName(joined.select(F.col("set_key").alias("a"), "b")).distinct()


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits`` bits per set, one for each key by its hash."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, keys in zip(out, sets):
        place = keys & np.uint64(bits - 1)
        np.bitwise_or.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def tile_links(
    names: list[int], sets: list[np.ndarray], labels: list[int], probe: list[bool]
) -> list[tuple[int, int]]:
    """Links that join the sets of a tile, none between sets that are joined already.

    Sets with equal labels count as joined.  A pair is compared if either side
    is a probe.  Every component of the links among compared pairs and labels
    is a component of the result.
    """
    order = sorted(range(len(sets)), key=lambda i: (sets[i].size, names[i]))
    names, sets = [names[i] for i in order], [sets[i] for i in order]
    _, label = np.unique([labels[i] for i in order], return_inverse=True)
    probe_ = np.array([probe[i] for i in order])
    sizes = np.array([s.size for s in sets])
    bits = 1 << max(6, int(4 * np.median(sizes) - 1).bit_length())
    marks = bitmaps(sets, bits)
    links = []
    for i in range(len(sets)):
        end = np.searchsorted(sizes, sizes[i] * 100 // PERCENT, "right")
        others = np.arange(i + 1, end)
        others = others[(label[others] != label[i]) & (probe_[others] | probe_[i])]
        if not others.size:
            continue
        differ = np.bitwise_count(marks[others] ^ marks[i]).sum(axis=1, dtype=np.int64)
        both = sizes[others] + sizes[i]
        # The overlap is at most half of what the differing bits leave.
        others = others[100 * ((both - differ) // 2) >= PERCENT * (both - (both - differ) // 2)]
        for j in others:
            if label[j] != label[i]:
                overlap = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if linked(overlap, sizes[i], sizes[j]):
                    links.append((names[i], names[j]))
                    label[label == label[j]] = label[i]
    return links


def _band(size: Column) -> Column:
    """Bands whose ends differ by a quarter, so linked sets are in one band or in neighbours."""
    return F.floor(F.log(size.cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")


def _links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` within tiles.

    ``members`` has a row per set and tile: ``row, row2, set_key, cluster, band,
    block, label, probe``.  The shingles of a set are made once more from the text
    of the document ``row, row2``, and only here they leave its row.
    """

    def make():
        shingler = Shingler()
        return lambda batch: [_keys_of(batch, shingler)]

    tile = F.struct("cluster", "band", "block", "label", "probe")
    by_row = members.groupBy("row", "row2", "set_key").agg(F.collect_list(tile).alias("tiles"))
    texts = join_by_size(docs.select(*ROW, "text"), materialize(by_row, "tile-members"), ROW, "inner")
    keyed = append_columns(texts, "text", "keys array<bigint>", make, drop=("text",))
    tiles = keyed.select("set_key", "keys", F.explode("tiles").alias("t")).select("t.*", "set_key", "keys")

    def work(table: pa.Table) -> pa.Table:
        column = table.column("keys").combine_chunks()
        values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        rows: dict[tuple, tuple] = {}
        for k, (name, label, probe) in enumerate(zip(*(table.column(c).to_pylist() for c in ("set_key", "label", "probe")))):
            if ends[k + 1] > ends[k]:
                rows[name, probe] = name, values[ends[k] : ends[k + 1]], label, probe
        found = tile_links(*map(list, zip(*rows.values()))) if rows else []
        columns = list(zip(*found)) or [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return tiles.groupBy("cluster", "band", "block").applyInArrow(work, "a bigint, b bigint")


def _tiles(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """A row per set and tile, with the number of ``blocks`` of the tile.

    The tile of a band has its own sets, which are probes, and those of the band
    above, which only meet probes.  Tiles without a pair to compare are left out.
    """
    sets = clusters.join(classes, "set_key").withColumn("band", _band(F.col("n_shingles")))
    placed = sets.withColumn("probe", F.lit(True)).unionByName(
        sets.withColumn("band", F.col("band") - 1).withColumn("probe", F.lit(False))
    )
    sizes = placed.groupBy("cluster", "band").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("probe").alias("probed"),
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"),
    )
    return placed.join(sizes.where("n > 1 AND probed").select("cluster", "band", "blocks"), ["cluster", "band"])


_MEMBER = ["row", "row2", "set_key", "cluster", "band", "block", "label", "probe"]


def _all_links(tiles: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of all tiles, enough to join what the links of all pairs join.

    A tile of one block is compared as a whole.  In a larger one, the sets of a
    block meet each other and a few leaders of the tile.  That joins most sets of
    a group of near copies; the sets outside the largest component of the tile,
    dealt into parts of bounded size, then meet the blocks, a part and a block at a time.
    """
    home = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = tiles.withColumn("block", home).withColumn("label", F.col("set_key"))
    large = tiles.where("blocks > 1")
    if large.isEmpty():
        return materialize(_links(own.select(_MEMBER), docs), "links")
    rank = F.expr("row_number() OVER (PARTITION BY cluster, band ORDER BY set_key)")
    leaders = large.withColumn("_n", rank).where(F.col("_n") <= LEADERS).drop("_n")
    leaders = leaders.withColumn("block", every).withColumn("label", F.col("set_key")).withColumn("probe", F.lit(True))
    first = materialize(_links(own.select(_MEMBER).unionByName(leaders.select(_MEMBER)), docs), "links")

    joined = connected_components(first).select(F.col("node").alias("set_key"), F.col("component").alias("_label"))
    labelled = materialize(
        large.join(joined, "set_key", "left")
        .withColumn("label", F.coalesce("_label", "set_key"))
        .drop("_label"),
        "labelled-tiles",
    )
    shares = labelled.groupBy("cluster", "band", "label").count()
    main = shares.groupBy("cluster", "band").agg(F.max(F.struct("count", "label"))["label"].alias("_main"))
    rest = labelled.join(main, ["cluster", "band"]).where("label <> _main").drop("_main")
    sizes = rest.groupBy("cluster", "band").agg(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("parts")
    )
    sizes = materialize(sizes, "tile-parts")
    # A pair of a block and a part of the rest is one number.
    part = F.pmod(F.xxhash64(F.lit("part"), "set_key"), F.col("parts")).cast("int")
    rest = rest.join(sizes, ["cluster", "band"]).withColumn("block", every)
    rest = rest.withColumn("block", F.col("block") * F.col("parts") + part).withColumn("probe", F.lit(True))
    met = labelled.join(sizes, ["cluster", "band"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("block", home * F.col("parts") + F.col("_part")).withColumn("probe", F.lit(False))
    second = materialize(_links(met.select(_MEMBER).unionByName(rest.select(_MEMBER)), docs), "links")
    return first.unionByName(second)


RESULTS = ("n_shingles", "component_id")

# What tells rows apart: 128 bits of id and text; equal rows are one.
ROW = ["row", "row2"]


def _with_rows(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row": F.xxhash64("doc_id", "text"), "row2": F.xxhash64("text", "doc_id")})


def _classified(docs: DataFrame) -> DataFrame:
    """``(kept, doc_id, row, row2, label, n_shingles, component_id)`` of documents ``(kept, doc_id, text)``.

    The label tells components apart, also those of documents that share an id.
    """
    source = _with_rows(docs)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(source))
    numbered = shingle_sets(source, frequent).withColumn("set_key", F.monotonically_increasing_id())
    found = materialize(numbered, "shingle-sets")

    # A set is known by its name here and by a number from here on: that of its
    # first row, which has steps.  Copies in other tasks look for candidates by
    # their own numbers, find the same ones, and are left out when the classes are
    # joined; so the steps never leave their rows but to meet each other.
    name = ["key", "key2"]
    classes = (
        found.where("key IS NOT NULL")
        .groupBy(*name)
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct(*ROW)).alias("r"),
            F.first("n_shingles").alias("n_shingles"),
            F.count(F.lit(1)).alias("copies"),
            F.min("set_key").alias("set_key"),
        )
        .select(*name, "doc_id", "r.*", "n_shingles", "copies", "set_key")
    )
    classes = materialize(classes, "shingle-classes")
    clusters = connected_components(_candidates(found.select("set_key", "rare", "often"))).select(
        F.col("node").alias("set_key"), F.col("component").alias("cluster")
    )
    tiles = materialize(_tiles(clusters, classes.select("set_key", *ROW, "n_shingles")), "tiles")
    joined = connected_components(_all_links(tiles, source.select(*ROW, "text")))

    # Linked sets take the smallest id of their component, the others their own.
    linked_ = joined.join(classes.select(F.col("set_key").alias("node"), "doc_id"), "node")
    smallest = linked_.groupBy("component").agg(F.min("doc_id").alias("_linked"))
    of_set = joined.join(smallest, "component").select(
        F.col("node").alias("set_key"), F.col("component").alias("_label"), "_linked"
    )
    ids = classes.join(of_set, "set_key", "left").select(
        *name,
        "copies",
        F.coalesce("_label", "set_key").alias("label"),
        F.when(F.col("_label").isNull(), F.col("doc_id")).otherwise(F.col("_linked")).alias("component_id"),
    )
    ids = materialize(ids, "set-components")
    rows = found.drop("rare", "often", "set_key")
    total = found.agg(F.count(F.lit(1))).first()[0]
    known = join_counted(rows.where("key IS NOT NULL"), ids, name, "copies", total).drop(*name)
    empty = rows.where("key IS NULL").drop(*name).withColumns(
        {"label": F.lit(None).cast("bigint"), "component_id": F.col("doc_id")}
    )
    return known.unionByName(empty)


def similarity_classes(docs: DataFrame) -> DataFrame:
    """Add ``n_shingles`` and ``component_id`` to documents ``(doc_id, text, ...)``; the text is dropped.

    Words are what white space separates, A-Z lower-cased; a text of fewer than
    five words is one shingle.  ``component_id`` is the smallest ``doc_id`` that is
    reachable by links, the document itself included.

    A text without words, or null, has no shingles and links with nothing.
    Repeated rows and equal sets are in one component.  A null ``doc_id`` takes
    part but is nobody's smallest id, unless there is no other.  Other columns
    stay, but those named like a result are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in (*RESULTS, "text")]
    # The caller's columns travel as one, so their names meet no others here.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), "doc_id", "text")
    return _classified(packed).select(*[F.col("kept").getField(c).alias(c) for c in kept], *RESULTS)


def one_per_group(docs: DataFrame) -> DataFrame:
    """The document with the smallest ``doc_id`` of every component, in the columns of ``docs``.

    Of several texts with that id one stays, and of equal rows one.  Documents
    without words all stay.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", "text")
    found = _classified(packed.select(F.lit(0).alias("kept"), "doc_id", "text"))
    found = materialize(found.select("doc_id", *ROW, "label"), "components")
    grouped = found.where("label IS NOT NULL")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW))
    first = grouped.groupBy("label").agg(best.alias("first")).select("first.row", "first.row2")
    losers = grouped.select(*ROW).distinct().join(first, ROW, "left_anti")
    rows = _with_rows(packed)
    kept = join_by_size(rows, materialize(losers, "near-copies"), ROW, "left_anti")
    equal = grouped.groupBy(*ROW).count().where("count > 1").join(first, ROW, "left_semi").select(*ROW)
    equal = materialize(equal, "equal-rows")
    unpacked = [F.col("own").getField(c).alias(c) for c in docs.columns]
    if equal.isEmpty():
        return kept.select(*unpacked)
    single = join_by_size(kept, equal, ROW, "left_anti")
    once = join_by_size(kept, equal, ROW, "left_semi").dropDuplicates(ROW)
    return single.unionByName(once).select(*unpacked)
