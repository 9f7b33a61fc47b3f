"""Column functions on file contents and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusquery.functions.binding import indices, let, let2, running

NEWLINE = "\n"


def split_lines(content: Column) -> Column:
    """Lines of a file without their newline.

    A final newline ends the last line; it does not start another one.
    """
    return let(
        F.split(content, NEWLINE, -1),
        lambda parts: F.when(
            (F.size(parts) > 1) & (F.element_at(parts, F.lit(-1)) == ""),
            F.slice(parts, 1, F.size(parts) - 1),
        ).otherwise(parts),
    )


def strip_newlines(line: Column) -> Column:
    """Remove newlines at the end of a line (P5)."""
    return F.rtrim(line, F.lit(NEWLINE))


def slice_lines(content: Column, offset: int = 0, limit: int = 0) -> Column:
    """Skip ``offset`` lines and keep ``limit`` (0 keeps all), newlines included.

    The text after a final newline counts as one more, empty, line, so an
    offset equal to the number of newlines still gives ``""``.
    """
    if offset <= 0 and limit <= 0:
        return content
    skip = max(offset, 0)

    def cut(parts: Column) -> Column:
        total = F.size(parts)
        kept = F.slice(parts, skip + 1, F.lit(limit) if limit > 0 else F.greatest(total, F.lit(1)))
        reaches_end = F.lit(skip) + F.size(kept) >= total
        return F.when(F.lit(skip) >= total, F.lit("")).otherwise(
            F.concat(
                F.array_join(kept, NEWLINE),
                F.when(reaches_end, F.lit("")).otherwise(F.lit(NEWLINE)),
            )
        )

    return let(F.split(content, NEWLINE, -1), cut)


def fragments(line: Column, pattern: str) -> Column:
    """Byte offset and byte length of every match of ``pattern`` in ``line``.

    Zero-width matches are left out.
    """
    regex = F.lit(pattern)

    def locate(pieces: Column, found: Column) -> Column:
        # A split never yields an empty piece before a zero-width first match.
        aligned = F.when(
            F.size(pieces) == F.size(found), F.concat(F.array(F.lit("")), pieces)
        ).otherwise(pieces)

        def offsets(gaps: Column) -> Column:
            steps = F.transform(
                found,
                lambda m, k: F.octet_length(m) + F.octet_length(gaps[k]),
            )
            return let(
                running(steps, lambda a, b: a + b, F.lit(0)),
                lambda ends: F.transform(
                    found,
                    lambda m, k: F.struct(
                        (ends[k] - F.octet_length(m)).alias("off"),
                        F.octet_length(m).alias("len"),
                    ),
                ),
            )

        return F.filter(let(aligned, offsets), lambda f: f["len"] > 0)

    return let2(
        F.split(line, pattern, -1),
        F.regexp_extract_all(line, regex, F.lit(0)),
        locate,
    )


def all_fragments(line: Column, patterns: list[str]) -> Column:
    """Fragments of several patterns in offset order."""
    if len(patterns) == 1:
        return fragments(line, patterns[0])
    return F.array_sort(F.concat(*[fragments(line, p) for p in patterns]))


def column_number(frags: Column) -> Column:
    """1-based byte column of the first listed fragment, 1 without fragments."""
    return F.when(F.size(frags) > 0, F.get(frags, F.lit(0))["off"] + 1).otherwise(F.lit(1))


def _bytes_text(binary: Column, start: Column, length: Column) -> Column:
    """Text of a byte range that starts and ends between characters."""
    return F.substring(binary, start + 1, length).cast("string")


def highlight(line: Column, frags: Column, open_mark: str, close_mark: str) -> Column:
    """Wrap matched bytes in markers.

    Fragments are taken in offset order and cut at the end of the line;
    fragments that overlap share one pair of markers.
    """
    opening, closing = F.lit(open_mark), F.lit(close_mark)

    def paint(ordered: Column, binary: Column) -> Column:
        size = F.octet_length(binary)
        stops = running(
            F.transform(ordered, lambda f: F.least(f["off"] + f["len"], size)),
            lambda a, b: F.greatest(a, b),
            F.lit(0),
        )

        def join_pieces(ends: Column) -> Column:
            count = F.size(ordered)

            def piece(f: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0))
                continues = (k > 0) & (f["off"] < before)
                start = F.greatest(f["off"], before)
                gap = _bytes_text(binary, before, F.greatest(f["off"] - before, F.lit(0)))
                body = _bytes_text(binary, start, F.greatest(ends[k] - start, F.lit(0)))
                stays_open = (k + 1 < count) & (F.get(ordered, k + 1)["off"] < ends[k])
                return F.concat(
                    gap,
                    F.when(continues, F.lit("")).otherwise(opening),
                    body,
                    F.when(stays_open, F.lit("")).otherwise(closing),
                )

            last = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
            return F.concat(
                F.array_join(F.transform(ordered, piece), ""),
                _bytes_text(binary, last, F.greatest(size - last, F.lit(0))),
            )

        return let(stops, join_pieces)

    return let2(F.array_sort(frags), F.encode(line, "UTF-8"), paint)


def snippets(line: Column, frags: Column, width: int = 100) -> Column:
    """Each match with at most ``width`` characters on either side.

    A character takes at most four bytes, so only ``4 * width`` bytes around
    the match are ever cut out of the line.
    """
    reach = 4 * width

    def cut(binary: Column) -> Column:
        def one(f: Column) -> Column:
            from_byte = F.greatest(f["off"] - reach, F.lit(0))
            stop = f["off"] + f["len"]
            return F.struct(
                f["off"].alias("off"),
                F.right(_bytes_text(binary, from_byte, f["off"] - from_byte), F.lit(width)).alias("pre"),
                _bytes_text(binary, f["off"], f["len"]).alias("hit"),
                F.left(_bytes_text(binary, stop, F.lit(reach)), F.lit(width)).alias("post"),
            )

        return F.transform(frags, one)

    return let(F.encode(line, "UTF-8"), cut)


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a text, empty when it is shorter than ``n``.

    The look-ahead yields overlapping grams in one linear pass.  A gram never
    starts inside a surrogate pair, so it is always made of whole characters.
    """
    gram = rf"(?s)(?=(\P{{Cs}}.{{{n - 1}}}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(gram), F.lit(1)))


def repo_parts(repo: Column) -> Column:
    """Split ``host/owner/name`` into its parts; ``valid`` is false with fewer than three."""
    return let(
        F.split(repo, "/", 3),
        lambda p: F.struct(
            (F.size(p) == 3).alias("valid"),
            F.get(p, F.lit(0)).alias("host"),
            F.get(p, F.lit(1)).alias("owner"),
            F.get(p, F.lit(2)).alias("name"),
        ),
    )


def url_host(url: Column) -> Column:
    """Host of a URL without its port; null when the URL has none (P10)."""
    return F.try_parse_url(url, F.lit("HOST"))


def file_key(repo: Column, path: Column, separator: str = ":") -> Column:
    """Name of a file in results: ``repo:path`` or ``repo/path``."""
    return F.concat_ws(separator, repo, path)


def line_range_key(first: Column, last: Column) -> Column:
    """``"7"`` for one line, ``"7-9"`` for a run of lines."""
    return F.when(first == last, first.cast("string")).otherwise(
        F.concat_ws("-", first.cast("string"), last.cast("string"))
    )


def line_ranges(matches: Column) -> Column:
    """Group consecutive line numbers of a file's matches.

    ``matches`` is an array of structs with ``line_no`` and ``line`` in line
    order.  Only one row is touched, so grouping lines needs no shuffle.
    """

    def group(hits: Column) -> Column:
        starts = F.filter(
            indices(hits),
            lambda i: (i == 1) | (hits[i - 1]["line_no"] != F.get(hits, i - 2)["line_no"] + 1),
        )

        def ranges(first_at: Column) -> Column:
            def one(begin: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(first_at, k + 1) - 1, F.size(hits))
                return F.struct(
                    line_range_key(hits[begin - 1]["line_no"], hits[stop - 1]["line_no"]).alias("range"),
                    F.array_join(
                        F.transform(
                            F.slice(hits, begin, stop - begin + 1),
                            lambda h: strip_newlines(h["line"]),
                        ),
                        NEWLINE,
                    ).alias("text"),
                )

            return F.transform(first_at, one)

        return let(starts, ranges)

    return let(matches, group)
