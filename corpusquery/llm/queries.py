"""One registered query per operator, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusquery.llm.byte_bpe import decode, encode
from corpusquery.llm.decontaminate import contamination
from corpusquery.llm.jaccard_join import similarity_classes
from corpusquery.llm.language_id import identify_languages
from corpusquery.llm.lexical_search import rank_documents
from corpusquery.llm.license_scan import scan_licenses
from corpusquery.llm.line_dedup import drop_recurring_lines
from corpusquery.llm.line_rules import line_quality
from corpusquery.llm.merkle import build_manifest, record_digest
from corpusquery.llm.packing import pack_documents
from corpusquery.llm.token_index import write_token_store
from corpusquery.llm.url_filter import judge_urls
from corpusquery.llm.warc import assemble, read_warc, write_warc
from corpusquery.plans.joins import join_by_size, materialize

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {}

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
WORD_BPE = "word_bpe_49k.json"
WORD_END_ID = 0
SEQUENCE_TOKENS = 2048
RANKED = 10


def query(fn: Query) -> Query:
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def token_digests(docs: DataFrame) -> DataFrame:
    """Add number and digest of the ids of each text, and the digest of what they decode to."""
    path, pattern = public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN
    tokens = encode(docs, path, pattern)
    # The measures of the ids are taken before the decoder replaces them.
    measured = tokens.withColumns(
        {
            "n_tokens": F.size("ids").cast("bigint"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
        }
    )
    decoded = decode(measured, path, pattern, as_text=False)
    return decoded.withColumn("decoded_sha256", F.sha2("bytes", 256)).drop("bytes")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their way back, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines, as counts and digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select(
        "doc_id",
        "n_dropped",
        "words_before",
        "words_after",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license that covers its template best, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = F.get("licenses", F.lit(0))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        *[best[c].alias(c) for c in ("license", "matched", "template_words", "first_word", "end_word")],
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, from a model of the labelled documents and the other evidence."""
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_languages(table(spark, sf_dir, "pages"), labelled)
    return found.select("page_id", "host", "suffix", "declared", "text_language", "language", "confidence")


@query
def op10_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the ids of all documents, read back by key."""
    docs = table(spark, sf_dir, "documents")
    store = write_token_store(docs, public_tokenizers.path(BYTE_BPE), END_ID)
    return store.read(store.lookup(docs), ids=False)


@query
def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive, read back and joined to one row per capture."""
    archives = write_warc(table(spark, sf_dir, "pages"))
    # The records are joined several times and read from the archives once.
    records = materialize(read_warc(archives, keep_payload=False), "warc-records")
    page = lambda fields: fields["pageid"].cast("bigint")
    return assemble(records).select(
        page(F.col("metadata.fields")).alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        page(F.col("refers_to_metadata.fields")).alias("refers_to"),
    )


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similarity 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_classes(docs).select("doc_id", "n_shingles", "component_id")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return line_quality(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for every item of the benchmark."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), RANKED)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents, and every leaf folded to the root after tampering with some."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    digest = lambda text: F.unhex(record_digest(*map(F.col, fields), text))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    records = docs.select(
        F.col("source").alias("grp"),
        F.col("doc_id").alias("key"),
        digest(F.col("text")).alias("digest"),
        F.when(tampered, digest(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"),
    )
    manifest = build_manifest(records)
    leaves = manifest.leaves.select(
        "grp",
        "pos",
        F.col("key").alias("doc_id"),
        F.col("digest").alias("leaf"),
        F.coalesce("changed", "digest").alias("digest"),
    )
    folded = manifest.fold(leaves, "doc_id", "leaf")
    roots = join_by_size(
        folded, manifest.subroots.withColumnRenamed("digest", "subroot"), ["grp"], "left", spread_by=["pos"]
    ).withColumn("root", manifest.root.scalar())
    text = lambda name: F.lower(F.hex(name))
    return roots.select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


@query
def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, with the place and a check sum of every piece."""
    docs = table(spark, sf_dir, "documents")
    packing = pack_documents(docs, public_tokenizers.path(WORD_BPE), WORD_END_ID, SEQUENCE_TOKENS)
    pieces = packing.pieces.select(
        "uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pieces.join(packing.places, "uid").drop("uid")
