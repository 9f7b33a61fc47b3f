"""Token ids of documents in binary shards, with keyed access through a minimal perfect hash.

Layout of a store, a folder that all executors share::

    shard-000000.ids   ids of whole documents, end id included, back to back
    shard-000000.len   number of ids of each of these documents, 32 bits
    index-000000.npz   one bucket of the index

Documents lie in ascending order of ``doc_id`` over the shards.  Ids have 16
bits if the vocabulary allows, else 32, little-endian.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusquery.llm.arrow import arrow_schema, slices, strings
from corpusquery.llm.byte_bpe import Encoder
from corpusquery.llm.files import TaskFile, open_folder, read_whole, write_whole
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.session import shared_dir

# Keys of an index bucket; a bucket is built and opened as a whole.
KEYS_PER_BUCKET = 100_000

# A document without id is stored under this one.
NULL_KEY = -(1 << 63)

# Bits per key and level of the hash, and the levels before the rest is listed.
GAMMA = 2
MAX_LEVELS = 24

# Chunks whose ids a worker remembers over all of its tasks, about 250 bytes each.
REMEMBERED_CHUNKS = 1_000_000

# Bytes that a reader takes from a shard at once when its documents are neighbours.
READ_BYTES = 8 << 20


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (the finaliser of splitmix64, a fixed public function)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys.

    Level by level, keys that are alone on their bit of a bit array stay there
    and the others move on.  The slot of a key is the number of set bits
    before its own, so n keys fill slots 0 to n - 1.  The few keys that share
    bits on every level are listed.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.bits = int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while left.size and len(sizes) < MAX_LEVELS:
            size = 64 * max(1, math.ceil(GAMMA * left.size / 64))
            places = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[places]]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        return cls(np.array(sizes, np.int64), words, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gets any slot or -1."""
        out = np.full(keys.size, -1, np.int64)
        left, start = np.arange(keys.size), 0
        for level, size in enumerate(self.sizes):
            places = start + (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            value = self.words[word]
            here = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.before[word] + below)[here]
            left, start = left[~here], start + size
        if left.size and self.rest.size:
            at = np.minimum(np.searchsorted(self.rest, keys[left]), self.rest.size - 1)
            found = self.rest[at] == keys[left]
            out[left[found]] = self.bits + at[found]
        return out


@dataclass
class Bucket:
    """A bucket of the index: fingerprint and runs of documents of every slot."""

    hash: PerfectHash
    fingerprints: np.ndarray
    first: np.ndarray  # place of the first run of a slot; the next slot ends it
    runs: dict[str, np.ndarray]

    @classmethod
    def build(cls, keys: np.ndarray, runs: dict[str, np.ndarray]) -> Bucket:
        """From a key per run, equal keys meaning copies, and the columns of the runs."""
        unique = np.unique(keys)
        hash_ = PerfectHash.build(unique)
        fingerprints = np.zeros(unique.size, np.uint32)
        fingerprints[hash_.slots(unique)] = fingerprint(unique)
        slots = hash_.slots(keys)
        order = np.lexsort((runs["shard"], slots))
        first = np.searchsorted(slots[order], np.arange(unique.size + 1))
        return cls(hash_, fingerprints, first, {k: v[order] for k, v in runs.items()})

    def dump(self) -> bytes:
        out = io.BytesIO()
        h = self.hash
        np.savez(
            out, sizes=h.sizes, words=h.words, rest=h.rest, fingerprints=self.fingerprints, first=self.first,
            **{f"run_{k}": v for k, v in self.runs.items()},
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Bucket:
        with np.load(io.BytesIO(data)) as x:
            runs = {k[4:]: x[k] for k in x.files if k.startswith("run_")}
            return cls(PerfectHash(x["sizes"], x["words"], x["rest"]), x["fingerprints"], x["first"], runs)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where slot or fingerprint say that it is not stored."""
        slots = self.hash.slots(keys)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == fingerprint(keys[known])
        return np.where(known, slots, -1)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NULL_KEY))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str | None) -> Encoder:
    return Encoder(path, pattern, REMEMBERED_CHUNKS)


@lru_cache(maxsize=4)
def _open_bucket(store: str, bucket: int) -> Bucket:
    return Bucket.load(read_whole(store, f"index-{bucket:06d}.npz"))


@dataclass
class TokenStore:
    """A written store; ``width`` is the size of an id in bytes."""

    spark: SparkSession
    folder: str
    width: int
    buckets: int
    shards: DataFrame  # shard, n_docs, n_tokens, start: ids in all shards before it

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents with a key, read with one hash and one look per run."""
        key = NULL_KEY if doc_id is None else doc_id
        frame = self.spark.createDataFrame([(key,)], "key bigint").select(_bucket(self.buckets).alias("b"))
        bucket = _open_bucket(self.folder, frame.first()["b"])
        keys = np.array([key], np.int64)
        return [
            ids
            for run in _runs(bucket, keys, bucket.find(keys))
            for *_, ids in _read_runs(self.folder, self.width, [run])
        ]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``(doc_id, shard, ordinal, offset, n_docs, n_ids)`` runs of the stored keys among ``doc_id``.

        Every key is asked for once, next to the others of its bucket.
        """
        folder = self.folder
        asked = keys.select(_key("doc_id").alias("key")).distinct().withColumn("bucket", _bucket(self.buckets))
        ddl = "doc_id bigint, shard int, ordinal bigint, offset bigint, n_docs bigint, n_ids bigint"
        schema = arrow_schema(ddl)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("key").to_numpy()
                numbers = batch.column("bucket").to_numpy()
                for number in np.unique(numbers):
                    own = keys[numbers == number]
                    bucket = _open_bucket(folder, int(number))
                    runs = _runs(bucket, own, bucket.find(own))
                    columns = list(zip(*runs)) or [[] for _ in schema]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                    )

        return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, ddl)

    def read(self, runs: DataFrame, ids: bool = True) -> DataFrame:
        """Documents of looked-up runs: ``(doc_id, start, n_tokens, ids_crc32, ids)``.

        ``start`` counts the ids of all documents before it in the store, and
        ``ids_crc32`` is the unsigned crc32 of the ids as 32-bit little-endian
        integers.  ``ids`` (array<bigint>) is left out on demand.  The reads of a
        shard follow its order.
        """
        folder, width = self.folder, self.width
        ddl = "doc_id bigint, shard int, offset bigint, n_tokens bigint, ids_crc32 bigint"
        if ids:
            ddl += ", ids array<bigint>"
        schema = arrow_schema(ddl)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, held = [], 0
                runs = zip(*(c.to_pylist() for c in batch.columns))
                for key, shard, offset, found in _read_runs(folder, width, runs):
                    row = (
                        None if key == NULL_KEY else key,
                        shard,
                        offset,
                        found.size,
                        zlib.crc32(found.astype("<u4").tobytes()),
                    )
                    rows.append((*row, found.astype(np.int64)) if ids else row)
                    held += found.size if ids else 16
                    if held > READ_BYTES // 8:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

        near = runs.repartition("shard").sortWithinPartitions("shard", "ordinal").mapInArrow(work, ddl)
        starts = self.shards.select("shard", F.col("start").alias("_start"))
        placed = join_by_size(near, starts, ["shard"], "left")
        out = ["doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
        return placed.select(*out, *(["ids"] if ids else []))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


def _runs(bucket: Bucket, keys: np.ndarray, slots: np.ndarray) -> list[tuple]:
    """Rows of the runs of each found key."""
    names = ("shard", "ordinal", "offset", "n_docs", "n_ids")
    out = []
    for key, slot in zip(keys.tolist(), slots.tolist()):
        if slot >= 0:
            for at in range(bucket.first[slot], bucket.first[slot + 1]):
                out.append((key, *(int(bucket.runs[n][at]) for n in names)))
    return out


def _read_runs(folder: str, width: int, runs) -> Iterator[tuple]:
    """``(key, shard, offset, ids)`` of every document of the runs, reading ahead within a shard."""
    fs, path = open_folder(folder)
    dtype = np.dtype(f"<u{width}")
    name, source, window, at = None, None, b"", 0
    for key, shard, ordinal, offset, n_docs, n_ids in runs:
        if shard != name:
            if source is not None:
                source.close()
            name, window, at = shard, b"", 0
            source = fs.open_input_file(f"{path}/shard-{shard:06d}.ids")
        lo, hi = offset * width, (offset + n_ids) * width
        if lo < at or hi > at + len(window):
            window = source.read_at(max(hi - lo, min(READ_BYTES, source.size() - lo)), lo)
            at = lo
        ids = np.frombuffer(window, dtype, n_ids, lo - at)
        if n_docs == 1:
            yield key, shard, offset, ids
        else:
            with fs.open_input_file(f"{path}/shard-{shard:06d}.len") as lengths:
                cuts = np.frombuffer(lengths.read_at(4 * n_docs, 4 * ordinal), "<u4").astype(np.int64)
            ends = np.cumsum(cuts)
            for a, b in zip(ends - cuts, ends):
                yield key, shard, offset + int(a), ids[a:b]
    if source is not None:
        source.close()


def write_token_store(docs: DataFrame, path: str, end_id: int, pattern: str | None = None) -> TokenStore:
    """Encode every ``text`` of documents ``(doc_id, text)`` and write the store with its index.

    Ids come without special tokens; ``end_id`` follows each document.  Shards
    are ranges of ``doc_id``, written by one task each, so nothing but the
    texts is shuffled.  The index takes a row per document.

    A null or empty text is stored as the end id alone.  Repeated ids are
    stored one after the other, ordered by text, under one key; a null id comes
    first, under a key of its own.  Other columns are ignored.  An empty table
    gives a store without shards.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-store")
    ddl = "key bigint, shard int, ordinal bigint, offset bigint, n_ids bigint"
    schema = arrow_schema(ddl)
    width = Encoder(path, pattern).dtype.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder, ids, lengths = _encoder(path, pattern), None, None
        end = np.array([end_id], encoder.dtype).tobytes()
        ordinal = offset = 0
        for batch in batches:
            for part in slices(batch, "text"):
                if ids is None:
                    ids = TaskFile(folder, f"shard-{shard:06d}.ids")
                    lengths = TaskFile(folder, f"shard-{shard:06d}.len")
                raws = [encoder.raw(t) + end for t in strings(part.column("text"))]
                sizes = np.array([len(r) // encoder.dtype.itemsize for r in raws], np.int64)
                ids.write(b"".join(raws))
                lengths.write(sizes.astype("<u4").tobytes())
                n = len(raws)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(np.arange(ordinal, ordinal + n)),
                        pa.array(offset + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                    ],
                    schema=schema,
                )
                ordinal, offset = ordinal + n, offset + int(sizes.sum())
        if ids is not None:
            ids.commit()
            lengths.commit()

    tie = F.xxhash64("text")
    ordered = (
        docs.select(_key("doc_id").alias("key"), "text")
        .repartitionByRange("key", tie)
        .sortWithinPartitions("key", tie, "text")
    )
    written = materialize(ordered.mapInArrow(write, ddl), "token-entries")

    # Copies of a key meet in one run per shard before anything is grouped by bucket.
    runs = written.groupBy("key", "shard").agg(
        F.min("ordinal").alias("ordinal"),
        F.min("offset").alias("offset"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_ids").alias("n_ids"),
    )
    runs = materialize(runs, "token-runs")
    buckets = max(1, math.ceil(runs.count() / KEYS_PER_BUCKET))

    def build(table: pa.Table) -> pa.Table:
        columns = {n: table.column(n).to_numpy() for n in table.column_names}
        bucket = Bucket.build(
            columns["key"], {n: columns[n] for n in ("shard", "ordinal", "offset", "n_docs", "n_ids")}
        )
        number = int(columns["bucket"][0])
        write_whole(folder, f"index-{number:06d}.npz", bucket.dump())
        return pa.table({"bucket": pa.array([number], pa.int64()), "keys": [bucket.fingerprints.size]})

    # The bucket holds a bounded number of keys, however many documents share one.
    built = runs.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, "bucket bigint, keys bigint")
    materialize(built, "token-buckets")

    sums = runs.groupBy("shard").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_tokens")
    )
    # One row per shard, so one task can order them.
    shards = materialize(sums.selectExpr("*", "sum(n_tokens) OVER (ORDER BY shard) - n_tokens AS start"), "token-shards")
    return TokenStore(spark, folder, width, buckets, shards)
