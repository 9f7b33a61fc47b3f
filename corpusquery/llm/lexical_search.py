"""Ranked lexical search by a pipeline of term owners.

Terms are owned by stages, rare ones by the first.  A bundle of items visits
the stages in turn and carries its sparse accumulators, the scores that
documents have so far; a stage meets the bundle by cogroup, adds the integer
contributions of its terms and hands the accumulators on.  After the last stage
the best documents of each item are selected.

Documents lie in shards of bounded size and a bundle holds a bounded number of
items, so what meets in a task is bounded however frequent a term is.  Between
stages an item knows a score that its last ranked document reaches for certain;
accumulators that cannot reach it with all that later stages may add are not
carried on.  That never changes a result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusquery.llm.arrow import arrow_schema, rows_to_batch, slices, strings
from corpusquery.plans.joins import is_small, join_by_size, materialize

# Documents and words of a shard; a document is never cut.
SHARD_DOCS = 4096
SHARD_WORDS = 8_000_000

# Items of a bundle.
BUNDLE = 256

# A stage owns the terms in at most this share of the documents that no stage before it owns.
OWNED_SHARES = (1 / 64, 1 / 16, 1 / 4, 1.0)

# A term adds less than its weight times this.
UNIT = 1_000_000

# Letters, digits and everything beyond ASCII make terms; A-Z are lower-cased.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8").translate(_BYTES).split()


class Shard:
    """Postings of some documents while they are gathered."""

    def __init__(self, known: frozenset[bytes] | None, most_docs: int, most_words: int):
        self.known, self.most_docs, self.most_words = known, most_docs, most_words
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.kept: list[int] = []
        self.words: list[bytes] = []

    def add(self, doc_id: int | None, text: str) -> None:
        words = terms(text)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        if self.known is not None:
            words = list(filter(self.known.__contains__, words))
        self.kept.append(len(words))
        self.words += words

    @property
    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or len(self.words) >= self.most_words

    def postings(self) -> Iterator[tuple[bytes, bytes, bytes]]:
        """Term, documents (places in the shard, ascending) and how often it occurs in each."""
        number: dict[bytes, int] = {}
        occurrences = np.fromiter(
            (number.setdefault(w, len(number)) for w in self.words), np.int64, len(self.words)
        )
        docs = np.repeat(np.arange(len(self.ids)), self.kept)
        pairs, counts = np.unique((occurrences << 32) | docs, return_counts=True)
        ends = np.cumsum(np.bincount(pairs >> 32, minlength=len(number)))
        places, counts = (pairs & 0xFFFFFFFF).astype("<u2"), counts.astype("<u4")
        start = 0
        for word, end in zip(number, ends.tolist()):
            yield word, places[start:end].tobytes(), counts[start:end].tobytes()
            start = end


POSTINGS = (
    "shard bigint, term binary, places binary, counts binary, "
    "ids array<bigint>, sizes binary, n_docs bigint, n_terms bigint"
)


def index_documents(docs: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """Postings of ``(doc_id, text)`` by shard and term, and a row without term for each shard.

    With ``known``, a set of terms, only their postings are kept.  Shards follow
    the splits of the input, so no text is shuffled.
    """
    schema = arrow_schema(POSTINGS)
    limits = SHARD_DOCS, SHARD_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = Shard(known and known.value, *limits)

        def flush() -> Iterator[pa.RecordBatch]:
            if not shard.ids:
                return
            sizes = np.array(shard.sizes, "<u4")
            found, total = int((sizes > 0).sum()), int(sizes.sum(dtype=np.int64))
            rows = [(number, None, None, None, shard.ids, sizes.tobytes(), found, total)]
            for term, places, counts in shard.postings():
                rows.append((number, term, places, counts, None, None, None, None))
                if len(rows) >= 10_000:
                    yield rows_to_batch(rows, schema)
                    rows = []
            yield rows_to_batch(rows, schema)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text"))):
                    shard.add(doc_id, text)
                    if shard.full:
                        yield from flush()
                        shard, number = Shard(known and known.value, *limits), number + 1
        yield from flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, POSTINGS)


def asked_terms(items: DataFrame) -> DataFrame:
    """``(bundle, slot, term, q)``: how often each item holds a term."""
    ddl = "bundle int, slot int, term binary, q bigint"
    schema = arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = [part.column(c).to_pylist() for c in ("bundle", "slot")]
                rows = [
                    (bundle, slot, term, q)
                    for bundle, slot, text in zip(*columns, strings(part.column("text")))
                    for term, q in Counter(terms(text)).items()
                ]
                yield rows_to_batch(rows, schema)

    return items.select("bundle", "slot", "text").mapInArrow(work, ddl)


def bundled(items: DataFrame, *keep: str) -> DataFrame:
    """Items with the number of their bundle and their slot in it, dealt out evenly."""
    bundles = max(1, math.ceil(items.count() / BUNDLE))
    dealt = items.select(*keep).repartition(bundles)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int")
    return materialize(dealt.withColumns({"bundle": F.spark_partition_id(), "slot": place}), "items")


def local_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each row, 0 where there are fewer."""
    if scores.shape[1] < k:
        return np.zeros(len(scores), np.int64)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def add_stage(left: pa.Table, right: pa.Table, n_docs: int, n_terms: int) -> tuple[np.ndarray, dict]:
    """Scores ``(slots, documents)`` of a bundle in a shard after the terms of a stage, and the bundle's row."""
    row = {name: left.column(name)[0].as_py() for name in left.column_names if name != "ids"}
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    norm = 25 + (75 * sizes * n_docs) // n_terms
    scores = np.zeros((len(row["bounds"]), len(sizes)), np.int64)
    slots, places = (np.frombuffer(row[c], "<u2") for c in ("slots", "places"))
    scores[slots, places] = np.frombuffer(row["scores"], "<i8")
    columns = [right.column(c).to_pylist() for c in ("at", "counts", "weight", "members")]
    for at, counts, weight, members in zip(*columns):
        at, counts = np.frombuffer(at, "<u2"), np.frombuffer(counts, "<u4").astype(np.int64)
        part = weight * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[at]))
        for member in members:
            scores[member["slot"], at] += member["q"] * part
    return scores, row


CARRIED = (
    "bundle int, shard bigint, ids array<bigint>, sizes binary, slots binary, places binary, scores binary, "
    "best array<struct<slot: int, score: bigint>>"
)
FOUND = "bundle int, slot int, doc_id bigint, score bigint"


def _advance(n_docs: int, n_terms: int, k: int, schema: pa.Schema):
    """A stage in the middle: accumulators in, accumulators out."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, row = add_stage(left, right, n_docs, n_terms)
        known = np.array([b["reached"] for b in row["bounds"]], np.int64)
        later = np.array([b["later"] for b in row["bounds"]], np.int64)
        reached = np.maximum(known, local_best(scores, k))
        slots, places = np.nonzero((scores > 0) & (scores + later[:, None] >= reached[:, None]))
        kept = scores[slots, places]
        # What each item has reached here, for the bound over all shards.
        order = np.lexsort((-kept, slots))
        nth = np.arange(len(order)) - np.searchsorted(slots[order], slots[order])
        top = order[nth < k]
        top = top[kept[top] >= known[slots[top]]]
        best = [{"slot": s, "score": x} for s, x in zip(slots[top].tolist(), kept[top].tolist())]
        columns = [
            pa.array([row["bundle"]], pa.int32()),
            pa.array([row["shard"]], pa.int64()),
            left.column("ids").combine_chunks(),
            *(
                pa.array([x], pa.binary())
                for x in (
                    row["sizes"],
                    slots.astype("<u2").tobytes(),
                    places.astype("<u2").tobytes(),
                    kept.astype("<i8").tobytes(),
                )
            ),
            pa.array([best], schema.field("best").type),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return work


def _select(n_docs: int, n_terms: int, k: int, schema: pa.Schema):
    """The last stage: the best documents of each item in a shard."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, row = add_stage(left, right, n_docs, n_terms)
        known = np.array([b["reached"] for b in row["bounds"]], np.int64)
        least = np.maximum(np.maximum(known, local_best(scores, k)), 1)
        slots, places = np.nonzero(scores >= least[:, None])
        kept = scores[slots, places]
        ids = left.column("ids").combine_chunks().flatten().take(pa.array(places))
        # Null ids come first among equal scores.
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        order = np.lexsort((number, ~absent, -kept, slots))
        nth = np.arange(len(order)) - np.searchsorted(slots[order], slots[order])
        top = order[nth < k]
        columns = [
            pa.array(np.full(len(top), row["bundle"]), pa.int32()),
            pa.array(slots[top], pa.int32()),
            ids.take(pa.array(top)),
            pa.array(kept[top], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return work


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item: ``(item_id, rank, doc_id, score)``.

    ``docs`` has ``(doc_id, text)``, ``items`` has ``(item_id, text)``.  Terms are
    runs of ASCII letters and digits and of all characters beyond ASCII, without
    regard to the case of A-Z.  The score of a document sums, over the terms of
    an item with repeats, a weight that falls with the number of documents
    holding the term, times a share that grows with the occurrences and falls
    with the length of the document; all but the logarithm is integer.  Equal
    scores rank by ``doc_id``, nulls first.  Documents that score 0 are left out.

    A null or empty text has no terms.  Repeated rows are documents, or items,
    of their own.  Other columns are ignored.  Empty tables rank nothing.
    """
    session = docs.sparkSession
    dealt = bundled(items, "item_id", "text")
    asked = materialize(asked_terms(dealt), "asked-terms")
    vocabulary = asked.select("term").distinct()
    known = None
    if is_small(vocabulary):
        # A short list of terms is compared next to the texts, a long one joined below.
        known = session.sparkContext.broadcast(frozenset(bytes(r.term) for r in vocabulary.collect()))
    index = materialize(index_documents(docs, known), "postings")
    shards = index.where("term IS NULL").select("shard", "ids", "sizes", "n_docs", "n_terms")
    shards = materialize(shards, "shards")
    postings = index.where("term IS NOT NULL").select("shard", "term", F.col("places").alias("at"), "counts")
    total = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    bundles = dealt.agg(F.max("bundle")).first()[0]
    if not n_docs or bundles is None:
        zero = F.lit(0).cast("bigint")
        return dealt.limit(0).select("item_id", F.lit(1).alias("rank"), zero.alias("doc_id"), zero.alias("score"))

    df = F.sum(F.octet_length("at") / 2).cast("bigint")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    stage = F.lit(len(OWNED_SHARES) - 1)
    for s in reversed(range(len(OWNED_SHARES) - 1)):
        stage = F.when(F.col("df") <= F.lit(OWNED_SHARES[s] * n_docs), s).otherwise(stage)
    weights = join_by_size(postings, vocabulary, ["term"], "left_semi", spread_by=["shard"])
    weights = materialize(
        weights.groupBy("term").agg(df.alias("df")).select("term", weight.alias("weight"), stage.alias("stage")).where("weight > 0"),
        "weights",
    )
    wanted = materialize(join_by_size(asked, weights, ["term"], "inner", spread_by=["bundle", "slot"]), "wanted")
    owners = wanted.groupBy("stage", "term", "bundle", "weight").agg(
        F.collect_list(F.struct("slot", "q")).alias("members")
    )
    owners = materialize(owners, "owners")
    # Per item, all that stages after each one may add.
    later = wanted.groupBy("bundle", "slot").agg(
        *[
            F.sum(F.when(F.col("stage") > s, F.col("q") * F.col("weight") * UNIT).otherwise(0)).alias(f"later_{s}")
            for s in range(len(OWNED_SHARES))
        ]
    )
    later = materialize(dealt.select("bundle", "slot").join(later, ["bundle", "slot"], "left"), "later")

    nothing = F.lit(b"")
    carried = shards.select(
        F.explode(F.sequence(F.lit(0), F.lit(bundles))).alias("bundle"),
        "shard",
        "ids",
        "sizes",
        *[nothing.alias(c) for c in ("slots", "places", "scores")],
    )
    # A score that the last ranked document of an item reaches for certain.
    reached = dealt.select("bundle", "slot", F.lit(0).cast("bigint").alias("reached"))
    for s in range(len(OWNED_SHARES)):
        bounds = later.select("bundle", "slot", F.coalesce(f"later_{s}", F.lit(0)).alias("later"))
        bounds = bounds.join(reached, ["bundle", "slot"])
        bounds = bounds.groupBy("bundle").agg(
            F.sort_array(F.collect_list(F.struct("slot", "later", "reached"))).alias("bounds")
        )
        bundle_rows = join_by_size(
            carried.select("bundle", "shard", "ids", "sizes", "slots", "places", "scores"),
            materialize(bounds, f"bounds-{s}"),
            ["bundle"],
            "inner",
            spread_by=["shard"],
        )
        own = owners.where(F.col("stage") == s).drop("stage")
        met = join_by_size(postings, own, ["term"], "inner", spread_by=["shard"])
        met = met.select("bundle", "shard", "at", "counts", "weight", "members")
        pairs = bundle_rows.groupBy("bundle", "shard").cogroup(met.groupBy("bundle", "shard"))
        if s + 1 < len(OWNED_SHARES):
            carried = materialize(
                pairs.applyInArrow(_advance(n_docs, n_terms, k, arrow_schema(CARRIED)), CARRIED), f"carried-{s}"
            )
            best = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"))
            seen = carried.select("bundle", F.inline("best")).withColumn("nth", F.row_number().over(best))
            kth = seen.where(F.col("nth") == k).select("bundle", "slot", F.col("score").alias("reached"))
            reached = reached.unionByName(kth).groupBy("bundle", "slot").agg(F.max("reached").alias("reached"))
    found = pairs.applyInArrow(_select(n_docs, n_terms, k, arrow_schema(FOUND)), FOUND)
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = ranked.join(dealt.select("bundle", "slot", "item_id"), ["bundle", "slot"])
    return named.select("item_id", "rank", "doc_id", "score")
