"""Line-level operators: matches, context, ranges, chunks and rendering.

A file is one row, so everything that relates lines of the same file is done
inside that row with array functions.  None of these operators shuffles.
Computed arrays are exploded with the ``outer`` form and nulls dropped after
it; the inner form would make the optimizer evaluate the array a second time
in a size filter below the generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusquery.functions.binding import indices, let
from corpusquery.functions.text import (
    all_fragments,
    column_number,
    file_key,
    highlight,
    line_range_key,
    line_ranges,
    snippets,
    split_lines,
    strip_newlines,
)
from corpusquery.plans.predicates import Predicate

FILE = ["repo", "path"]


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return (
        files.select(*FILE, F.posexplode_outer(split_lines(F.col("content"))).alias("pos", "line"))
        .where(F.col("line").isNotNull())
        .select(*FILE, (F.col("pos") + 1).alias("line_no"), "line")
    )


def symbol_columns(files: DataFrame, predicate: Predicate) -> list[str]:
    """Columns with the symbol hits of the predicate, as far as they are joined on."""
    return [a.hits() for a in predicate.symbol_atoms() if a.hits() in files.columns]


def _spots(symbol_hits: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c), F.array().cast(SPOTS_TYPE)) for c in symbol_hits]


def matching_numbers(predicate: Predicate, symbol_hits: list[str], all_lines: Column) -> Column:
    """Numbers of the lines a predicate selects, in order.

    A line is selected when any positive content atom matches it or when it
    defines a symbol of a positive symbol atom.
    """
    atoms = predicate.line_atoms()

    def hit(line: Column) -> Column:
        found = atoms[0].line_column(line)
        for atom in atoms[1:]:
            found = found | atom.line_column(line)
        return found

    lists = [spot["line_no"] for spot in _spots(symbol_hits)]
    if atoms:
        lists.append(F.filter(indices(all_lines), lambda n: hit(all_lines[n - 1])))
    if not lists:
        return F.array().cast("array<int>")
    return lists[0] if len(lists) == 1 else F.array_sort(F.array_distinct(F.concat(*lists)))


def matches_column(predicate: Predicate, context: int = 0, symbol_hits: list[str] = ()) -> Column:
    """Matching lines of a file as an array of structs.

    Each entry carries the line, the byte fragments of all positive atoms and
    up to ``context`` lines before and after it, clipped to the file.
    ``symbol_hits`` names the columns with the definitions of symbol atoms.
    """
    patterns = [a.line_pattern() for a in predicate.line_atoms()]
    no_fragments = F.array().cast(FRAGMENTS_TYPE)
    no_lines = F.array().cast("array<string>")

    def line_fragments(n: Column, line: Column) -> Column:
        found = []
        if patterns:
            plain = lambda f: F.struct(
                f["off"].alias("off"),
                f["len"].alias("len"),
                F.lit(None).cast(SYMBOL_TYPE).alias("symbol"),
            )
            found.append(F.transform(all_fragments(line, patterns), plain))
        for spot in _spots(symbol_hits):
            at = F.array_position(spot["line_no"], n).cast("int")
            found.append(F.coalesce(F.get(spot, at - 1)["fragments"], no_fragments))
        if not found:
            return no_fragments
        return found[0] if len(found) == 1 else F.array_sort(F.concat(*found))

    def collect(all_lines: Column) -> Column:
        def entry(n: Column) -> Column:
            line = all_lines[n - 1]
            first = F.greatest(n - context, F.lit(1))
            before = F.slice(all_lines, first, F.least(n - 1, F.lit(context)))
            return F.struct(
                n.alias("line_no"),
                line.alias("line"),
                (before if context else no_lines).alias("before"),
                (F.slice(all_lines, n + 1, context) if context else no_lines).alias("after"),
                line_fragments(n, line).alias("fragments"),
            )

        return F.transform(matching_numbers(predicate, symbol_hits, all_lines), entry)

    return let(split_lines(F.col("content")), collect)


SYMBOL_TYPE = "struct<sym:string,kind:string,parent:string,parent_kind:string>"
FRAGMENTS_TYPE = f"array<struct<off:int,len:int,symbol:{SYMBOL_TYPE}>>"
SPOTS_TYPE = f"array<struct<line_no:int,fragments:{FRAGMENTS_TYPE}>>"
MATCHES_TYPE = (
    "array<struct<line_no:int,line:string,before:array<string>,after:array<string>,"
    f"fragments:{FRAGMENTS_TYPE}>>"
)


def with_matches(files: DataFrame, predicate: Predicate, context: int = 0) -> DataFrame:
    """Replace the content of already filtered files by their matching lines."""
    hits = symbol_columns(files, predicate)
    kept = [c for c in files.columns if c != "content" and c not in hits]
    return files.select(*kept, matches_column(predicate, context, hits).alias("matches"))


def _explode(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias("x")).where(F.col("x").isNotNull())


def match_rows(matched: DataFrame) -> DataFrame:
    """One row per matching line (P2) with its column number."""
    return _explode(matched, F.col("matches"), *FILE).select(
        *FILE,
        "x.line_no",
        column_number(F.col("x.fragments")).alias("col"),
        strip_newlines(F.col("x.line")).alias("line"),
        "x.before",
        "x.after",
        "x.fragments",
    )


def fragment_rows(matched: DataFrame) -> DataFrame:
    """One row per match inside a line."""
    flat = F.flatten(
        F.transform(
            F.col("matches"),
            lambda m: F.transform(
                m["fragments"],
                lambda f: F.struct(
                    m["line_no"].alias("line_no"), f["off"].alias("off"), f["len"].alias("len"),
                    f["symbol"].alias("symbol"),
                ),
            ),
        )
    )
    return _explode(matched, flat, *FILE).select(*FILE, "x.line_no", "x.off", "x.len", "x.symbol")


def context_rows(matched: DataFrame) -> DataFrame:
    """One row per context line of each match."""

    def around(m: Column) -> Column:
        first = m["line_no"] - F.size(m["before"])
        row = lambda number, side, text: F.struct(
            m["line_no"].alias("match_line"),
            number.alias("line_no"),
            F.lit(side).alias("side"),
            text.alias("line"),
        )
        return F.concat(
            F.transform(m["before"], lambda t, i: row(first + i, "before", t)),
            F.transform(m["after"], lambda t, i: row(m["line_no"] + 1 + i, "after", t)),
        )

    flat = F.flatten(F.transform(F.col("matches"), around))
    return _explode(matched, flat, *FILE).select(
        *FILE, "x.match_line", "x.line_no", "x.side", "x.line"
    )


def context_by_window(file_lines: DataFrame, match_lines: DataFrame, context: int) -> DataFrame:
    """Context from line rows instead of whole files.

    For corpora stored one line per row.  A match asks for ``2 * context``
    line numbers, and each is found by an equi-join on the file and the line.
    """
    wanted = match_lines.select(
        *FILE,
        F.col("line_no").alias("match_line"),
        F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no"),
    ).where(F.col("line_no") != F.col("match_line"))
    return file_lines.join(wanted, [*FILE, "line_no"]).select(
        *FILE,
        "match_line",
        "line_no",
        F.when(F.col("line_no") < F.col("match_line"), "before").otherwise("after").alias("side"),
        "line",
    )


def range_rows(matched: DataFrame) -> DataFrame:
    """Consecutive matching lines joined into ranges."""
    return _explode(matched, line_ranges(F.col("matches")), *FILE).select(*FILE, "x.range", "x.text")


def ranges_map(matched: DataFrame) -> DataFrame:
    """Lines mode: one row per file with a map from range to text.

    Files without a matching line are left out, as they have nothing to show.
    """
    as_map = let(
        line_ranges(F.col("matches")),
        lambda r: F.when(F.size(r) > 0, F.array(F.map_from_entries(r))),
    )
    return (
        matched.select(
            file_key(F.col("repo"), F.col("path")).alias("file"),
            F.explode_outer(as_map).alias("ranges"),
        )
        .where(F.col("ranges").isNotNull())
    )


def ranges_by_window(line_rows: DataFrame) -> DataFrame:
    """W1 for line rows ``(repo, path, line_no, line)`` of any origin.

    Repeated line numbers start a new range, as the gap test asks for exactly
    the next number: 5, 5, 6 gives ``5`` and ``5-6``.
    """
    in_file = W.partitionBy(*FILE).orderBy("line_no", "line")
    breaks = F.when(F.col("line_no") == F.lag("line_no").over(in_file) + 1, 0).otherwise(1)
    return (
        line_rows.withColumn("starts", breaks)
        .withColumn("island", F.sum("starts").over(in_file.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*FILE, "island")
        .agg(
            F.min("line_no").alias("first"),
            F.max("line_no").alias("last"),
            F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"),
        )
        .select(
            *FILE,
            line_range_key(F.col("first"), F.col("last")).alias("range"),
            F.array_join(F.transform("rows", lambda r: strip_newlines(r["line"])), "\n").alias("text"),
        )
    )


def chunk_rows(files: DataFrame, predicate: Predicate, context: int = 0) -> DataFrame:
    """Chunk mode: windows of a match and its context, merged where they touch."""
    chunks = chunks_column(predicate, context, symbol_columns(files, predicate))
    kept = files.select(*FILE, chunks.alias("chunks"))
    return _explode(kept, F.col("chunks"), *FILE).select(
        *FILE, "x.first_line", "x.last_line", "x.n_matches", "x.text"
    )


def chunks_column(predicate: Predicate, context: int, symbol_hits: list[str]) -> Column:
    def build(all_lines: Column) -> Column:
        total = F.size(all_lines)
        numbers = matching_numbers(predicate, symbol_hits, all_lines)

        def merge(hits: Column) -> Column:
            # Windows have equal width, so only the previous match can reach this one.
            starts = F.filter(
                indices(hits),
                lambda i: (i == 1) | (hits[i - 1] - context > F.get(hits, i - 2) + context + 1),
            )

            def one(begin: Column, k: Column, first_at: Column) -> Column:
                stop = F.coalesce(F.get(first_at, k + 1) - 1, F.size(hits))
                first = F.greatest(hits[begin - 1] - context, F.lit(1))
                last = F.least(hits[stop - 1] + context, total)
                return F.struct(
                    first.alias("first_line"),
                    last.alias("last_line"),
                    (stop - begin + 1).alias("n_matches"),
                    F.array_join(F.slice(all_lines, first, last - first + 1), "\n").alias("text"),
                )

            return let(starts, lambda at: F.transform(at, lambda b, k: one(b, k, at)))

        return let(numbers, merge)

    return let(split_lines(F.col("content")), build)


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merge intervals of any width that overlap or touch, per key.

    ``keys`` should identify a file: the intervals of one key are sorted
    together.
    """
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.withColumn("_new", F.when(F.col(start) <= reach + 1, 0).otherwise(1))
        .withColumn("_chunk", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_chunk")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_chunk")
    )


def rendered_column(gap_marks: bool, open_mark: str | None, close_mark: str | None) -> Column:
    """Output rows of a file in order: context, match and gap separator."""

    def row(kind: str, number: Column, col: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            number.cast("int").alias("line_no"),
            col.cast("int").alias("col"),
            text.alias("text"),
        )

    def block(m: Column, i: Column, hits: Column) -> Column:
        first = m["line_no"] - F.size(m["before"])
        previous = F.get(hits, i - 1)
        # The end of the last match counts, not the furthest one so far.
        gap = (i > 0) & (first > previous["line_no"] + F.size(previous["after"]) + 1)
        none = F.lit(None)
        separator = F.array(row("separator", none, none, F.lit("--")))
        text = strip_newlines(m["line"])
        if open_mark is not None:
            text = highlight(text, m["fragments"], open_mark, close_mark or "")
        parts = [
            F.transform(m["before"], lambda t, k: row("context", first + k, none, t)),
            F.array(row("match", m["line_no"], column_number(m["fragments"]), text)),
            F.transform(m["after"], lambda t, k: row("context", m["line_no"] + 1 + k, none, t)),
        ]
        if gap_marks:
            parts.insert(0, F.when(gap, separator).otherwise(F.slice(separator, 1, 0)))
        return F.concat(*parts)

    return let(
        F.col("matches"),
        lambda hits: F.flatten(F.transform(hits, lambda m, i: block(m, i, hits))),
    )


def render_rows(
    matched: DataFrame,
    context: int = 0,
    open_mark: str | None = None,
    close_mark: str | None = None,
) -> DataFrame:
    """One row per output line: ``(repo, path, seq, kind, line_no, col, text)``.

    Separators appear only when context was asked for.
    """
    rendered = rendered_column(context > 0, open_mark, close_mark)
    return (
        matched.select(*FILE, F.posexplode_outer(rendered).alias("pos", "x"))
        .where(F.col("x").isNotNull())
        .select(*FILE, (F.col("pos") + 1).alias("seq"), "x.kind", "x.line_no", "x.col", "x.text")
    )


def render_text(
    rendered: DataFrame,
    line_numbers: bool = True,
    columns: bool = False,
    heading: bool = False,
) -> DataFrame:
    """Text form of ``render_rows``: ``:`` joins a match line, ``-`` a context line."""
    name = file_key(F.col("repo"), F.col("path"), "/")
    number, col = F.col("line_no").cast("string"), F.col("col").cast("string")
    match_parts = [*([] if heading else [name])]
    match_parts += [number] if line_numbers else []
    match_parts += [col] if columns else []
    context_parts = [*([] if heading else [name]), *([number] if line_numbers else [])]
    out = (
        F.when(F.col("kind") == "match", F.concat_ws(":", *match_parts, F.col("text")))
        .when(F.col("kind") == "context", F.concat_ws("-", *context_parts, F.col("text")))
        .otherwise(F.col("text"))
    )
    return rendered.select(*FILE, "seq", out.alias("output"))


def vimgrep_rows(matched: DataFrame) -> DataFrame:
    """``path:line:col:text`` per matching line."""
    rows = match_rows(matched)
    return rows.select(
        *FILE,
        "line_no",
        F.concat_ws(
            ":",
            file_key(F.col("repo"), F.col("path"), "/"),
            F.col("line_no").cast("string"),
            F.col("col").cast("string"),
            F.col("line"),
        ).alias("output"),
    )


def highlighted_rows(matched: DataFrame, open_mark: str, close_mark: str) -> DataFrame:
    """Matching lines with their fragments wrapped in markers."""
    painted = F.transform(
        F.col("matches"),
        lambda m: F.struct(
            m["line_no"].alias("line_no"),
            highlight(strip_newlines(m["line"]), m["fragments"], open_mark, close_mark).alias("line"),
        ),
    )
    return _explode(matched, painted, *FILE).select(*FILE, "x.line_no", "x.line")


def snippet_rows(matched: DataFrame, width: int = 100) -> DataFrame:
    """One row per match with bounded text on either side."""
    cut = F.flatten(
        F.transform(
            F.col("matches"),
            lambda m: F.transform(
                snippets(strip_newlines(m["line"]), m["fragments"], width),
                lambda s: F.struct(
                    m["line_no"].alias("line_no"),
                    s["off"].alias("off"),
                    s["pre"].alias("pre"),
                    s["hit"].alias("hit"),
                    s["post"].alias("post"),
                ),
            ),
        )
    )
    return _explode(matched, cut, *FILE).select(
        *FILE, "x.line_no", "x.off", "x.pre", "x.hit", "x.post"
    )
