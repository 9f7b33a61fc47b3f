"""Quality rules that clean a text line by line before they judge it.

Everything here is built from column functions; a document never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.functions.binding import let

SPACES = r"[ \t-\r]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# A line is navigation with this many separators and few words for each.
SEPARATORS = "|»›•·"
MIN_SEPARATORS = 3
MAX_WORDS_PER_SEPARATOR = 4

# A line is junk with more than one of these for every ten word characters.
SYMBOLS = "#*$%&<>|~^=_\\{}"
SYMBOL_SHARE = 10

# Phrases of page furniture count in short lines only; prose may mention them.
BOILERPLATE = (
    r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|"
    r"click here|sign (in|up)|log ?in|subscribe|read more|share (this|on)|lorem ipsum)\b"
)
MAX_BOILERPLATE_WORDS = 12

# What may end a line of prose, also before closing quotes and brackets.  A line
# without it is a fragment only if it is short and no sentence ends inside it:
# wrapped prose, and scripts with other marks or none, are longer than that.
SENTENCE_ENDS = ".!?…।。！？؟۔։።။"
CLOSING = r"[\"'”’»)\]]*[ \t-\r]"
TERMINAL = rf"[{SENTENCE_ENDS}:;]{CLOSING}*$"
INNER_END = rf"[{SENTENCE_ENDS}]{CLOSING}"
MAX_FRAGMENT_WORDS = 5
MAX_FRAGMENT_CHARS = 40

# A document that loses more than this share of its word characters is rejected.
MAX_LOST_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _word_chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.char_length(_without(text, " \t\n\x0b\f\r")).cast("bigint")


def _repeat_words(words: Column) -> Column:
    """Words inside any window of eight words that the text has twice or more.

    Windows are compared by a 64-bit hash.  Only a text with an equal pair
    sorts its windows; the covered words are then counted from their places.
    """

    def covered(sorted_windows: Column) -> Column:
        def equal(window: Column, k: Column) -> Column:
            before, after = F.get(sorted_windows, k - 1), F.get(sorted_windows, k + 1)
            same = (before["h"] == window["h"]) | (after["h"] == window["h"])
            return F.when(F.coalesce(same, F.lit(False)), window["i"])

        starts = F.array_sort(F.array_compact(F.transform(sorted_windows, equal)))
        step = lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, start, step, lambda acc: acc["n"])

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.array_sort(pairs), covered)
        ).otherwise(0)

    size = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )
    return F.when(size > WINDOW, let(hashes, count)).otherwise(0).cast("bigint")


def failed_line(line: Column) -> Column:
    """Whether a line with words is navigation, symbols, boilerplate or a bare fragment."""

    def judge(n: Column) -> Column:
        separators = F.char_length(line) - F.char_length(_without(line, SEPARATORS))
        navigation = (separators >= MIN_SEPARATORS) & (n <= MAX_WORDS_PER_SEPARATOR * separators)
        boilerplate = (n <= MAX_BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        symbols = F.char_length(line) - F.char_length(_without(line, SYMBOLS))
        junk = SYMBOL_SHARE * symbols > _word_chars(line)
        short = (n <= MAX_FRAGMENT_WORDS) & (F.char_length(line) <= MAX_FRAGMENT_CHARS)
        fragment = short & ~line.rlike(TERMINAL) & ~line.rlike(INNER_END)
        return (n > 0) & (navigation | junk | boilerplate | fragment)

    return let(F.size(words_of(line)), judge)


def quality(text: Column) -> Column:
    """All measures of a text and its cleaned form, as one struct.

    A null text counts as empty.
    """
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n"), _repeat_words(words).alias("r"))

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(r"[^ \t-\r]"))
        twice = let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("bigint")
        kept = F.array_join(F.filter(lines, lambda x: ~failed_line(x)), "\n")
        return F.struct(twice.alias("d"), kept.alias("t"))

    def verdict(w: Column, x: Column) -> Column:
        chars = _word_chars(whole)
        failed = (w["n"] < MIN_WORDS) | (100 * w["r"] > MAX_REPEAT_PERCENT * w["n"])
        left = _word_chars(x["t"])
        return let(
            chars,
            lambda c: F.struct(
                w["n"].alias("n_words"),
                c.alias("word_chars"),
                (F.char_length(whole) - F.char_length(_without(whole, "#*$%&|<>"))).cast("bigint").alias("n_symbols"),
                x["d"].alias("n_dup_lines"),
                w["r"].alias("n_repeat_words"),
                failed.alias("base_failed"),
                (~failed & (100 * (c - left) <= MAX_LOST_PERCENT * c)).alias("kept"),
                x["t"].alias("cleaned"),
            ),
        )

    return let(
        let(words_of(whole), of_words),
        lambda w: let(let(F.split(whole, "\n", -1), of_lines), lambda x: verdict(w, x)),
    )


MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "kept",
    "cleaned",
)


def line_quality(docs: DataFrame) -> DataFrame:
    """Add the measures of ``text``, the verdict ``kept`` and the ``cleaned`` text to documents.

    Lines that are navigation, symbols or boilerplate, and short ones without
    the end of a sentence, are removed from ``cleaned``.  A document is rejected
    for fewer than 20 words, for more than 30 % of its words in repeated windows
    of eight, or if cleaning takes over half of its word characters.

    A null or empty text has no words and is rejected, with ``cleaned`` empty.
    Repeated rows are judged alike and all returned.  Other columns stay, but
    those named like a measure are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    name = _unused(docs)
    measured = docs.select(*kept, quality(F.col("text")).alias(name))
    return measured.select(*kept, *[F.col(f"{name}.{m}").alias(m) for m in MEASURES])


def _unused(docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    name = "quality"
    while name in taken:
        name += "_"
    return name


def clean_documents(docs: DataFrame) -> DataFrame:
    """Kept documents with their cleaned text and length, in the columns of ``docs``."""
    # A generator evaluates the measures once; a filter on one of them would do so
    # a second time, below the projection that computes them.
    passed = F.filter(F.array(quality(F.col("text"))), lambda q: q["kept"])
    name = _unused(docs)
    kept = docs.select("*", F.explode_outer(passed).alias(name)).where(F.col(name).isNotNull())
    cleaned = F.col(f"{name}.cleaned")
    own = {"text": cleaned}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.char_length(cleaned).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[own[c.lower()].alias(c) if c.lower() in own else F.col(c) for c in docs.columns])
