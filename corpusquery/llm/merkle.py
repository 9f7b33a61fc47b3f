"""A Merkle manifest of a dataset: trees whose parents keep the hash states before each child.

Records are hashed, ordered within their group and joined in runs of three,
level by level, to the group's root; group roots are joined likewise to the
root.  A parent hashes its children's digests as text, each of which fills one
block, so the state before a child is eight words.  It is stored, and a changed
child needs only the state before it and the siblings to its right.

Trees are built in tiers: a block of ``BLOCK`` neighbouring nodes is one row
and is folded to one node in its task, and those nodes form the next tier.  A
block keeps all its nodes and states.  The way from a block up to the root is
put together from the top down, one short row per block, so a group of any
size meets no single task and no join has a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.llm import sha256
from corpusquery.llm.arrow import arrow_schema
from corpusquery.plans.joins import join_by_size, materialize

# Children of a parent, and the levels and nodes of a block.
FAN = 3
BLOCK_LEVELS = 5
BLOCK = FAN**BLOCK_LEVELS

# Leaves that climb together in a task.
CLIMBERS = 16_384

# One step up: place and size of the run, state before the place, the other digests in order.
STEP = np.dtype([("slot", "u1"), ("size", "u1"), ("state", "<u4", 8), ("siblings", "<u4", (FAN - 1, 8))])


def field_text(value: Column) -> Column:
    """A value with its length in bytes in front, ``-`` for null."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def record_digest(*values: Column) -> Column:
    """SHA-256 of a record's values, as hex text."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its group, and ``total``, the rows of the group.

    Rows are dealt out by ranges of group and order, so a large group is spread
    over tasks; only one count per group and range is summed up.  ``order`` has
    to be total.
    """
    placed = materialize(
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        "numbered",
    )
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = materialize(
        parts.selectExpr(
            f"`{group}`",
            "_part",
            "_first",
            f"sum(_n) OVER (PARTITION BY `{group}` ORDER BY _part) - _n AS _start",
            f"sum(_n) OVER (PARTITION BY `{group}`) AS total",
        ),
        "starts",
    )
    return (
        join_by_size(placed, starts, [group, "_part"], "inner")
        .withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first"))
        .drop("_part", "_at", "_first", "_start")
    )


def level_sizes(n: int, levels: int) -> list[int]:
    """Nodes on each level of a block, the top one included."""
    sizes = [n]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def _levels(total: int) -> int:
    """Levels of a block of a group with so many nodes in its tier."""
    levels = 0
    while total > 1 and levels < BLOCK_LEVELS:
        total, levels = -(-total // FAN), levels + 1
    return levels


def build_blocks(leaves: list[np.ndarray], levels: list[int]) -> list[tuple[bytes, bytes, bytes]]:
    """Nodes below the top, states and top of each block, all blocks level by level together.

    A parent has ``FAN - 1`` states: before its second child, before its third.
    The one before the first is the start of every hash.
    """
    nodes: list[list[bytes]] = [[] for _ in leaves]
    states: list[list[bytes]] = [[] for _ in leaves]
    tops = list(leaves)
    for level in range(max(levels, default=0)):
        active = [b for b, n in enumerate(levels) if n > level]
        sizes = np.array([len(tops[b]) for b in active])
        parents = -(-sizes // FAN)
        ends = np.cumsum(parents)
        below = np.concatenate([tops[b] for b in active])
        # First child of each parent, and how many children it has.
        nth = np.arange(ends[-1]) - np.repeat(ends - parents, parents)
        first = np.repeat(np.cumsum(sizes) - sizes, parents) + FAN * nth
        count = np.minimum(FAN, np.repeat(sizes, parents) - FAN * nth)
        state = sha256.start(ends[-1])
        kept = np.zeros((ends[-1], FAN - 1, 8), np.uint32)
        for child in range(FAN):
            has = count > child
            if child:
                kept[has, child - 1] = state[has]
            state[has] = sha256.absorb(state[has], sha256.hex_blocks(below[first[has] + child]))
        above = sha256.finish(state, count)
        for b, lo, hi in zip(active, ends - parents, ends):
            nodes[b].append(sha256.to_bytes(tops[b]))
            states[b].append(kept[lo:hi].astype("<u4").tobytes())
            tops[b] = above[lo:hi]
    return [(b"".join(n), b"".join(s), sha256.to_bytes(t)) for n, s, t in zip(nodes, states, tops)]


def block_steps(n: int, levels: int, nodes: bytes, states: bytes, at: np.ndarray) -> np.ndarray:
    """Steps ``(len(at), levels)`` from nodes of a block to its top."""
    steps = np.zeros((len(at), levels), STEP)
    digests = sha256.from_bytes(nodes)
    kept = np.frombuffer(states, "<u4").reshape(-1, FAN - 1, 8)
    sizes, below, above = level_sizes(n, levels), 0, 0
    for level in range(levels):
        parent, slot = at // FAN, at % FAN
        step = steps[:, level]
        step["slot"], step["size"] = slot, np.minimum(FAN, sizes[level] - FAN * parent)
        later = np.maximum(slot, 1) - 1
        step["state"] = np.where((slot == 0)[:, None], sha256.INITIAL, kept[above + parent, later])
        for k in range(FAN - 1):
            # The k-th of the others stands behind the node itself from its slot on.
            other = FAN * parent + k + (k >= slot)
            there = k < step["size"].astype(int) - 1
            step["siblings"][there, k] = digests[below + other[there]]
        below, above, at = below + sizes[level], above + sizes[level + 1], parent
    return steps


def climb(digests: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots that nodes fold to, and digests of their proofs.

    ``steps`` has a row per node; a step of size 0 is none.  Folding resumes the
    kept state with the node and goes on with the siblings to its right.  A proof
    is all siblings from the bottom up.
    """
    tops = digests.copy()
    proof, length = sha256.start(len(tops)), np.zeros(len(tops), np.int64)
    for level in range(steps.shape[1]):
        on = np.flatnonzero(steps["size"][:, level])
        if not on.size:
            continue
        step = steps[on, level]
        others = step["size"].astype(int) - 1
        state = sha256.absorb(step["state"].astype(np.uint32), sha256.hex_blocks(tops[on]))
        for k in range(FAN - 1):
            there = np.flatnonzero(k < others)
            if not there.size:
                continue
            block = sha256.hex_blocks(step["siblings"][there, k].astype(np.uint32))
            proof[on[there]] = sha256.absorb(proof[on[there]], block)
            length[on[there]] += 1
            right = k >= step["slot"][there]
            state[there[right]] = sha256.absorb(state[there[right]], block[right])
        tops[on] = sha256.finish(state, step["size"].astype(np.int64))
    return tops, sha256.finish(proof, length)


BLOCK_DDL = "grp string, block bigint, total bigint, n int, levels int, nodes binary, states binary, top binary"


def _build(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = batch.column("digests")
        flat = sha256.from_bytes(b"".join(digests.flatten().to_pylist()))
        sizes = digests.value_lengths().to_numpy()
        cuts = np.cumsum(sizes)
        totals = batch.column("total").to_pylist()
        levels = [_levels(t) for t in totals]
        built = build_blocks([flat[e - n : e] for e, n in zip(cuts, sizes)], levels)
        nodes, states, tops = zip(*built) if built else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("grp"),
                batch.column("block"),
                pa.array(totals, pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.array(levels, pa.int32()),
                *(pa.array(c, pa.binary()) for c in (nodes, states, tops)),
            ],
            schema=schema,
        )


@dataclass
class Tree:
    """Trees over the nodes of groups: ``(grp, pos, total, digest)`` per tier and its blocks."""

    tiers: list[DataFrame]
    blocks: list[DataFrame]

    @property
    def tops(self) -> DataFrame:
        """``(grp, digest)``: the root of each group."""
        done = [t.where("total = 1").select("grp", "digest") for t in self.tiers[1:]]
        return reduce(DataFrame.unionByName, done)


def grow(nodes: DataFrame, name: str) -> Tree:
    """Build the trees of all groups, tier by tier."""
    tallest = nodes.agg(F.max("total")).first()[0] or 1
    schema = arrow_schema(BLOCK_DDL)
    tiers, blocks = [nodes], []
    while not blocks or tallest > 1:
        below = tiers[-1] if not blocks else tiers[-1].where("total > 1")
        rows = below.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block"), "total").agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("members")
        )
        rows = rows.select("grp", "block", "total", F.col("members.digest").alias("digests"))
        built = materialize(rows.mapInArrow(lambda batches: _build(batches, schema), BLOCK_DDL), f"{name}-blocks")
        blocks.append(built)
        tallest = math.ceil(tallest / BLOCK)
        tiers.append(
            built.select(
                "grp",
                F.col("block").alias("pos"),
                F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"),
                F.col("top").alias("digest"),
            )
        )
    return Tree(tiers, blocks)


PATH_DDL = "grp string, pos bigint, path binary"


def _paths(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Way to the root of every node of a block: its steps, then those of the block's top."""
    names = ("grp", "block", "n", "levels", "nodes", "states", "path")
    for batch in batches:
        for grp, block, n, levels, nodes, states, above in zip(*(batch.column(c).to_pylist() for c in names)):
            steps = block_steps(n, levels, nodes, states, np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([grp] * n, pa.string()),
                    pa.array(block * BLOCK + np.arange(n), pa.int64()),
                    pa.array([s.tobytes() + above for s in steps], pa.binary()),
                ],
                schema=schema,
            )


def paths(tree: Tree, tier: int, above: DataFrame) -> DataFrame:
    """``(grp, pos, path)``: the way from every node of a tier, given ``(grp, path)`` of the groups' roots."""
    done = tree.tiers[tier]
    if tier:
        done = done.where("total = 1")
    # Beyond the last tier, or where a group is a single node already.
    ended = done.select("grp", "pos").join(above, "grp")
    if tier == len(tree.blocks):
        return ended
    upper = paths(tree, tier + 1, above).withColumnRenamed("pos", "block")
    inner = tree.blocks[tier].join(upper, ["grp", "block"])
    schema = arrow_schema(PATH_DDL)
    found = inner.mapInArrow(lambda batches: _paths(batches, schema), PATH_DDL)
    return materialize(found.unionByName(ended) if tier else found, "paths")


@dataclass
class Manifest:
    """Leaves ``(grp, pos, total, digest, ..)``, the trees of the groups and the tree of their roots."""

    leaves: DataFrame
    groups: Tree
    top: Tree

    @property
    def subroots(self) -> DataFrame:
        """``(grp, digest)`` of every group."""
        return self.groups.tops

    @property
    def root(self) -> DataFrame:
        """One row ``(digest)``; none for an empty dataset."""
        return self.top.tops.select("digest")

    def fold(self, leaves: DataFrame, *keep: str) -> DataFrame:
        """Roots that follow from other leaves: ``(grp, pos, *keep, folded, proof)``.

        ``leaves`` has ``(grp, pos, digest)``, the digest that stands at a place
        instead of the stored one, each on its own.  Every leaf climbs with the
        states and siblings of the manifest; none of the other leaves is hashed
        again.  ``proof`` is the digest of all siblings on its way.  ``keep``
        names columns that go along.
        """
        session = leaves.sparkSession
        single = self.top.tiers[0].select(F.col("order").alias("grp"), F.col("pos").alias("_pos"))
        end = session.createDataFrame([("", b"")], "grp string, path binary")
        way = paths(self.top, 0, end).select(F.col("pos").alias("_pos"), "path")
        above = materialize(single.join(way, "_pos").select("grp", "path"), "root-paths")
        upper = paths(self.groups, 1, above).withColumnRenamed("pos", "block")
        blocks = self.groups.blocks[0].select("grp", "block", "n", "levels", "nodes", "states")
        member = F.struct("pos", "digest", *keep)
        asked = leaves.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).agg(
            F.collect_list(member).alias("members")
        )
        kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
        ddl = ", ".join(["grp string", "pos bigint", *(f"`{k}` {kinds[k]}" for k in keep), "folded binary", "proof binary"])
        rows = asked.join(blocks, ["grp", "block"]).join(upper, ["grp", "block"])

        schema = arrow_schema(ddl)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _climbers(batch):
                    yield _fold(part, keep, schema)

        return rows.mapInArrow(work, ddl)


def _climbers(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of blocks in runs of bounded numbers of leaves."""
    sizes = batch.column("members").value_lengths().to_numpy()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CLIMBERS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _fold(batch: pa.RecordBatch, keep: tuple[str, ...], schema: pa.Schema) -> pa.RecordBatch:
    members = batch.column("members")
    flat, sizes = members.flatten(), members.value_lengths().to_numpy()
    column = dict(zip((f.name for f in flat.type), flat.flatten()))
    pos = column["pos"].to_numpy()
    ends = np.cumsum(sizes)
    inner = [
        block_steps(n, levels, nodes, states, pos[e - k : e] % BLOCK)
        for n, levels, nodes, states, e, k in zip(
            *(batch.column(c).to_pylist() for c in ("n", "levels", "nodes", "states")), ends, sizes
        )
    ]
    outer = [np.frombuffer(p, STEP) for p in batch.column("path").to_pylist()]
    low = max((s.shape[1] for s in inner), default=0)
    steps = np.zeros((len(pos), low + max((len(o) for o in outer), default=0)), STEP)
    for own, above, e, k in zip(inner, outer, ends, sizes):
        steps[e - k : e, : own.shape[1]] = own
        steps[e - k : e, low : low + len(above)] = above
    digests = sha256.from_bytes(b"".join(column["digest"].to_pylist()))
    folded, proof = climb(digests, steps)
    both = [pa.array([d.tobytes() for d in x.astype(">u4")], pa.binary()) for x in (folded, proof)]
    grp = pa.array(np.repeat(np.array(batch.column("grp").to_pylist(), object), sizes), pa.string())
    return pa.RecordBatch.from_arrays([grp, column["pos"], *(column[k] for k in keep), *both], schema=schema)


def build_manifest(records: DataFrame) -> Manifest:
    """Manifest of records ``(grp, key, digest, ..)``; other columns stay with the leaves.

    ``grp`` is the group's name and ``key`` orders the leaves of a group, nulls
    first; records of one key are ordered by digest.  ``digest`` is a binary
    SHA-256.  A null group is a group of its own, ahead of the others.  An empty
    table gives a manifest without leaves and without a root.  Repeated records
    are leaves of their own.
    """
    # A name that is never null, in the same order.
    named = F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit(""))
    rows = records.withColumns({"grp": named, "_row": F.monotonically_increasing_id()})
    rows = materialize(rows, "records")
    leaves = materialize(numbered(rows, "grp", ["key", "digest", "_row"]).drop("_row"), "leaves")
    groups = grow(leaves.select("grp", "pos", "total", "digest"), "group")
    tops = groups.tops.select(F.lit("").alias("grp"), F.col("grp").alias("order"), "digest")
    top = grow(materialize(numbered(tops, "grp", ["order"]), "subroots"), "top")
    return Manifest(leaves, groups, top)
