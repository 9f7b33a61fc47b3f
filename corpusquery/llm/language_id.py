"""Language of pages from text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.llm.arrow import append_columns, arrow_schema, own_columns, slices, strings
from corpusquery.llm.url_filter import url_host
from corpusquery.plans.joins import join_by_size, materialize

# Labelled documents per language that the text model is fitted on, those
# with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 2_000

# Character trigrams are hashed to this many features.
FEATURE_BITS = 15
SMOOTHING = 0.5

# A text counts as at most this many independent trigrams, since neighbouring
# trigrams say much the same.
MAX_EVIDENCE = 100

# Weight, in pages, of the level above in the prior of a suffix and of a host.
SUFFIX_WEIGHT = 20.0
HOST_WEIGHT = 10.0
# Pages that agree with nobody, for what a language declares.
DECLARED_WEIGHT = 1.0

TAG = re.compile(r"(<[^<>]*>)")
DECLARED = (
    r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)",
    r"(?is)<meta\b[^>]*?\bcontent-language\b[^>]*?\bcontent\s*=\s*[\"']?([a-z]+)",
)


def visible_text(html: str) -> str:
    """Text outside tags, scripts and styles."""
    out, hidden = [], None
    for part in TAG.split(html):
        if part.startswith("<") and part.endswith(">"):
            name = part[1:12].lower()
            if hidden is None:
                hidden = next((h for h in ("script", "style") if name.startswith(h)), None)
            elif name.startswith("/" + hidden):
                hidden = None
            out.append(" ")
        elif hidden is None:
            out.append(part)
    return "".join(out)


def features(text: str) -> np.ndarray:
    """Hashed trigrams of a lower-cased text in which everything but letters is a space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    if codes.size < 3:
        return np.zeros(0, np.int64)
    keys = (codes[:-2] * np.uint64(0x1F123BB5) + codes[1:-1] * np.uint64(0x2545F491) + codes[2:] * np.uint64(0x9E3779B1))
    blank = (codes[:-2] == 32) & (codes[1:-1] == 32)
    return ((keys ^ (keys >> np.uint64(17))) * np.uint64(0x85EBCA6B) >> np.uint64(20) & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)[~blank]


def fit_text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (language x feature) of labelled ``(doc_id, text, lang)``.

    Rows without text or language are left out.  Of a language with more than
    four times the sample, only about so many rows are ranked at all: those
    whose hash of id and text falls into that share.  So rows that are equal
    are ranked together or not at all.
    """
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    counts = materialize(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_count")), "labelled-counts")
    share = F.pmod(F.xxhash64("doc_id", "text"), F.col("_count")) < 4 * SAMPLE_PER_LANGUAGE
    order = F.expr("row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id), doc_id)")
    sample = (
        join_by_size(usable, counts, ["lang"], "inner", spread_by=["doc_id"])
        .where(share)
        .select("lang", "text", order.alias("_n"))
        .where(F.col("_n") <= SAMPLE_PER_LANGUAGE)
        .drop("_n")
    )
    ddl = "lang string, feature int, n bigint"
    schema = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), strings(part.column("text"))):
                    own = sums.setdefault(lang, np.zeros(1 << FEATURE_BITS, np.int64))
                    np.add.at(own, features(text), 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * at.size, pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                schema=schema,
            )

    counted = sample.mapInArrow(count, ddl).groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    # At most one number per language and feature.
    rows = counted.collect()
    languages = sorted({r["lang"] for r in rows})
    table = np.full((len(languages), 1 << FEATURE_BITS), SMOOTHING)
    for r in rows:
        table[languages.index(r["lang"]), r["feature"]] += r["n"]
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """Replace ``html`` by ``evidence``: a tempered log-likelihood per language, its maximum 0."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        table = shared.value

        def columns(batch):
            out = []
            for html in strings(batch.column("html")):
                seen = features(visible_text(html))
                scores = table[:, seen].sum(axis=1) if seen.size else np.zeros(len(table))
                scores *= min(1.0, MAX_EVIDENCE / max(1, seen.size))
                out.append((scores - scores.max()).tolist() if len(table) else [])
            return [out]

        return columns

    return append_columns(pages, "html", "evidence array<double>", make, drop=("html",))


def _softmax(scores: Column) -> Column:
    exp = F.transform(scores, lambda s: F.exp(s))
    return F.transform(exp, lambda e: e / F.aggregate(exp, F.lit(0.0), lambda a, b: a + b))


def _sums(pages: DataFrame, key: str, name: str, languages: list[str]) -> DataFrame:
    """Text posteriors summed over the pages of a key."""
    sums = [F.sum(F.col("_p")[i]).alias(f"_{i}") for i in range(len(languages))]
    summed = pages.groupBy(key).agg(*sums)
    return summed.select(key, F.array(*[f"_{i}" for i in range(len(languages))]).alias(name))


RESULTS = ("host", "suffix", "declared", "text_language", "language", "confidence")


def identify_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add the most probable language of pages ``(page_id, url, html)``.

    A trigram model of the text, fitted on ``labelled`` ``(doc_id, text,
    lang)``, gives a likelihood per language.  Its posteriors are summed by
    grouped aggregation over hosts, over suffixes (the last label of a host)
    and over all pages; a host is smoothed with its suffix, a suffix with the
    whole, and a page is left out of its own host.  The same sums by declared
    language (``lang`` of the html element or a content-language) tell how far a
    declaration can be trusted.  The language with the largest product of the
    three wins, of equal ones the alphabetically first.

    New columns: ``host``, ``suffix``, ``declared`` (null without one),
    ``text_language`` by text alone, ``language`` and its ``confidence``.  A page
    without text is decided by the other evidence; null urls share an empty
    host.  Without labelled rows the language is null.  Repeated pages are
    judged alike.  Other columns stay, but those named like a result are
    replaced; ``html`` is dropped.
    """
    names, own = own_columns(pages, {*RESULTS, "html"})
    # Hot hosts are spread by a hash of the page.
    mix = F.xxhash64(*[F.col(c) for c in ("page_id", "url") if c in pages.columns])
    found = _identified(pages.select(own.alias("own"), mix.alias("mix"), F.col("url"), F.col("html")), labelled)
    return found.select(*[F.col("own").getField(c).alias(c) for c in names], *RESULTS)


def _identified(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """``identify_languages`` of pages ``(own, mix, url, html)``."""
    kept = ["own", "mix"]
    languages, model = fit_text_model(labelled)
    named = pages.select(
        *kept,
        url_host(F.col("url")).alias("host"),
        F.lower(F.coalesce(*[F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in DECLARED])).alias("declared"),
        "html",
    )
    if not languages:
        none = F.lit(None).cast("string")
        return named.select(
            *kept, "host", F.substring_index("host", ".", -1).alias("suffix"), "declared",
            none.alias("text_language"), none.alias("language"), F.lit(None).cast("double").alias("confidence"),
        )
    n = len(languages)
    known = F.col("declared").isin(*languages)
    category = F.when(known, F.col("declared")).when(F.col("declared").isNull(), "none").otherwise("other")
    judged = text_evidence(named, model).select(
        *kept, "host", F.substring_index("host", ".", -1).alias("suffix"), "declared", category.alias("_said"),
        "evidence", _softmax(F.col("evidence")).alias("_p"),
    )
    judged = materialize(judged, "language-evidence")

    whole = _sums(judged.withColumn("_all", F.lit(1)), "_all", "_whole", languages).select("_whole")
    said = _sums(judged, "_said", "_by_said", languages)
    suffixes = _sums(judged, "suffix", "_by_suffix", languages)
    hosts = _sums(judged, "host", "_by_host", languages)

    joined = join_by_size(judged, hosts, ["host"], "left", spread_by=["mix"])
    joined = join_by_size(joined, suffixes, ["suffix"], "left", spread_by=["mix"])
    # Languages and two more rows; one row.
    joined = joined.join(F.broadcast(said), "_said", "left").crossJoin(F.broadcast(whole))

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    steps = joined.withColumn("_t", total(F.col("_whole")) + n)
    steps = steps.withColumn("_top", F.transform("_whole", lambda x: (x + 1) / F.col("_t")))
    steps = steps.withColumn("_t", total(F.col("_by_suffix")) + SUFFIX_WEIGHT)
    steps = steps.withColumn(
        "_mid", F.zip_with("_by_suffix", "_top", lambda x, up: (x + SUFFIX_WEIGHT * up) / F.col("_t"))
    )
    # The page itself is no evidence about its host.
    steps = steps.withColumn(
        "_others", F.zip_with("_by_host", "_p", lambda x, own: F.greatest(x - own, F.lit(0.0)))
    )
    steps = steps.withColumn("_t", total(F.col("_others")) + HOST_WEIGHT)
    steps = steps.withColumn(
        "_prior", F.zip_with("_others", "_mid", lambda x, up: (x + HOST_WEIGHT * up) / F.col("_t"))
    )
    declared = F.zip_with(
        "_by_said", "_whole", lambda x, all_: F.log((x + DECLARED_WEIGHT) / (all_ + DECLARED_WEIGHT * (n + 2)))
    )
    steps = steps.withColumn("_declared", declared)
    steps = steps.withColumn(
        "_score",
        F.zip_with(
            F.zip_with("evidence", "_declared", lambda a, b: a + b), "_prior", lambda a, b: a + F.log(b)
        ),
    )
    steps = steps.withColumn("_score", F.transform("_score", lambda s: s - F.array_max("_score")))
    steps = steps.withColumn("_post", _softmax(F.col("_score")))
    names = F.array(*[F.lit(x) for x in languages])
    first = lambda xs: names[F.array_position(xs, F.array_max(xs)).cast("int") - 1]
    return steps.select(
        *kept,
        "host",
        "suffix",
        "declared",
        first(F.col("evidence")).alias("text_language"),
        first(F.col("_score")).alias("language"),
        F.array_max("_post").alias("confidence"),
    )
