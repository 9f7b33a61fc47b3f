"""Line-level operators against row fixtures and against brute force."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from corpusquery import regex, search_lines, term
from corpusquery.functions import binding
from corpusquery.functions.text import (
    column_number, fragments, highlight, line_range_key, ngrams, repo_parts, slice_lines, snippets,
    split_lines, strip_newlines, url_host,
)
from corpusquery.operators import lines
from corpusquery.operators.search import matching_files


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "content,offset,limit,expected",
    [
        ("line0\nline1\nline2\nline3\n", 1, 2, "line1\nline2\n"),
        ("one\n", 10, 0, ""),
        ("one\n", 1, 0, ""),
        ("one\n", 2, 0, ""),
        ("", 0, 0, ""),
        ("", 1, 0, ""),
        ("abc", 0, 5, "abc"),
        ("a\n\nb", 1, 1, "\n"),
        ("a\n\nb", 2, 0, "b"),
        ("\n\n", 1, 1, "\n"),
        ("a\nb\n", 0, 2, "a\nb\n"),
        ("a\nb", 0, 1, "a\n"),
    ],
)
def test_slice_lines(spark, content, offset, limit, expected):
    assert value(spark, slice_lines(F.col("c"), offset, limit), c=content) == expected


@pytest.mark.parametrize(
    "content,expected",
    [("", [""]), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\n\nb", ["a", "", "b"])],
)
def test_split_lines(spark, content, expected):
    assert value(spark, split_lines(F.col("c")), c=content) == expected


def test_strip_newlines(spark):
    assert value(spark, strip_newlines(F.col("c")), c="a\n b \n\n") == "a\n b "


def test_fragments_in_bytes(spark):
    found = value(spark, fragments(F.col("c"), "(?iu)needle"), c="çaba needle x Needle")
    assert [(f.off, f.len) for f in found] == [(6, 6), (15, 6)]


PATTERNS = ["a*", "x|", "(?=b)b?", "é+", "ab|b", "^", "[ab]", "a(b)?"]
LINES = ["", "aab", "baab", "bébéé", "abab", "caaac"]


def test_fragments_like_a_matcher(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "c string")
    columns = [fragments(F.col("c"), p).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    for row in df.select("c", *columns).collect():
        for i, pattern in enumerate(PATTERNS):
            expected = [
                (len(row.c[: m.start()].encode()), len(m.group().encode()))
                for m in re.finditer(pattern, row.c)
                if m.group()
            ]
            assert [(f.off, f.len) for f in row[f"p{i}"]] == expected, (pattern, row.c)


def test_many_fragments_in_one_line(spark):
    """A single line with far more matches than one fold block."""
    n = 3 * binding.FOLD_BLOCK + 17
    got = value(spark, fragments(F.col("c"), "é"), c="xé" * n)
    assert [(f.off, f.len) for f in got] == [(3 * i + 1, 2) for i in range(n)]


def test_running_fold(spark):
    sizes = [0, 1, 255, 256, 257, 512, 1000]
    data = [(n, [(i * 37) % 101 for i in range(n)]) for n in sizes]
    df = spark.createDataFrame(data, "n int, v array<int>")
    fold = binding.running(F.col("v"), lambda a, b: a + b, F.lit(0))
    got = {r.n: r.s for r in df.select("n", fold.alias("s")).collect()}
    assert got == {n: list(itertools.accumulate(values)) for n, values in data}


FRAGS = "array<struct<off:int,len:int>>"


HIGHLIGHTS = [
    ("abcdef", [], "abcdef"),
    ("abcdef", [(1, 2)], "a<bc>def"),
    ("abcdef", [(4, 9)], "abcd<ef>"),
    ("abcdef", [(3, 1), (0, 1)], "<a>bc<d>ef"),
    ("abcdef", [(0, 3), (2, 2)], "<abcd>ef"),
    ("abcdef", [(0, 5), (1, 1), (3, 3)], "<abcdef>"),
    ("abcdef", [(0, 2), (2, 2)], "<ab><cd>ef"),
    ("éaé", [(2, 1)], "é<a>é"),
    ("éaé", [(0, 2), (3, 2)], "<é>a<é>"),
]


def test_highlight(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(HIGHLIGHTS)], f"i int, line string, frags {FRAGS}")
    painted = df.select("i", highlight(F.col("line"), F.col("frags"), "<", ">").alias("v"))
    assert {r.i: r.v for r in painted.collect()} == {i: c[2] for i, c in enumerate(HIGHLIGHTS)}


def test_snippet_width(spark):
    line = "é" * 300 + "needle" + "ß" * 300
    frag = fragments(F.col("c"), "needle")
    (got,) = value(spark, snippets(F.col("c"), frag), c=line)
    assert (got.pre, got.hit, got.post) == ("é" * 100, "needle", "ß" * 100)
    (short,) = value(spark, snippets(F.col("c"), frag, 5), c="ab😀needle")
    assert (short.pre, short.hit, short.post) == ("ab😀", "needle", "")


def test_column_number(spark):
    frag = fragments(F.col("c"), "b")
    assert value(spark, column_number(frag), c="éb") == 3
    assert value(spark, column_number(frag), c="x") == 1


def test_ngrams(spark):
    text = "abcabcé\n😀xy"
    assert sorted(value(spark, ngrams(F.col("c")), c=text)) == sorted(
        {text[i : i + 3] for i in range(len(text) - 2)}
    )
    assert value(spark, ngrams(F.col("c")), c="ab") == []
    assert value(spark, ngrams(F.col("c"), 1), c="aba") == ["a", "b"]


def test_names(spark):
    assert tuple(value(spark, repo_parts(F.col("c")), c="h/o/n/m")) == (True, "h", "o", "n/m")
    assert tuple(value(spark, repo_parts(F.col("c")), c="h/o"))[:3] == (False, "h", "o")
    assert value(spark, url_host(F.col("c")), c="https://git.example.com:8443/x?y#z") == "git.example.com"
    assert value(spark, url_host(F.col("c")), c="not a url") is None
    assert value(spark, line_range_key(F.lit(7), F.lit(9)), c="") == "7-9"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ranges_in_row_and_by_window(text_file):
    df = text_file("x\ny\nx\nx\nx\ny\nx", "x", "y", "x\nx\n")
    in_row = lines.range_rows(search_lines(df, term("x"), limit=None))
    expected = [("f0", "1", "x"), ("f0", "3-5", "x\nx\nx"), ("f0", "7", "x"), ("f1", "1", "x"), ("f3", "1-2", "x\nx")]
    assert rows(in_row, "path", "range", "text") == expected
    hits = lines.lines(df).where("line = 'x'")
    assert rows(lines.ranges_by_window(hits), "path", "range", "text") == expected


def test_repeated_line_numbers_break_a_range(spark):
    df = spark.createDataFrame(
        [("r", "p", 5, "a"), ("r", "p", 5, "b"), ("r", "p", 6, "c"),
         ("r", "q", 7, "d"), ("r", "q", 8, "e"), ("r", "q", 9, "f"), ("r", "q", 12, "g\n")],
        "repo string, path string, line_no int, line string",
    )
    assert rows(lines.ranges_by_window(df), "path", "range", "text") == [
        ("p", "5", "a"), ("p", "5-6", "b\nc"), ("q", "12", "g"), ("q", "7-9", "d\ne\nf"),
    ]


def test_lines_mode_map(spark):
    df = spark.createDataFrame([("repo", "a.go", "\n" * 9 + "func main()")], "repo string, path string, content string")
    row = lines.ranges_map(search_lines(df, term("func"), limit=None)).first()
    assert row.file == "repo:a.go" and row.ranges == {"10": "func main()"}


def test_file_without_matching_line(text_file):
    df = text_file("a\nb")
    predicate = regex(r"a\nb")
    assert matching_files(df, predicate).count() == 1
    found = search_lines(df, predicate, limit=None)
    assert found.first().matches == []
    assert lines.ranges_map(found).count() == 0 and lines.match_rows(found).count() == 0


def test_lines_come_from_positive_atoms(text_file):
    df = text_file("keep\nother\nmore keep\nfoo")
    found = search_lines(df, term("keep") & ~term("absent") & (term("foo") | term("bar")), limit=None)
    assert [m.line_no for m in found.first().matches] == [1, 3, 4]


def brute_context(texts, needle, c):
    out = []
    for i, t in enumerate(texts):
        ls = t.split("\n")
        for n, line in enumerate(ls, 1):
            if needle in line:
                for k in range(max(1, n - c), min(len(ls), n + c) + 1):
                    if k != n:
                        out.append((f"f{i}", n, k, "before" if k < n else "after", ls[k - 1]))
    return sorted(out)


TEXTS = ["x\na\nb\nx\nx\nc", "x", "a\nx", "a\nb\nc\nx\nd\ne\nf\ng\nx"]


@pytest.mark.parametrize("c", [1, 2, 5])
def test_context(text_file, c):
    df = text_file(*TEXTS)
    got = lines.context_rows(search_lines(df, term("x"), limit=None, context=c))
    expected = brute_context(TEXTS, "x", c)
    assert rows(got, "path", "match_line", "line_no", "side", "line") == expected
    all_lines = lines.lines(df)
    windowed = lines.context_by_window(all_lines, all_lines.where("line = 'x'"), c)
    assert rows(windowed, "path", "match_line", "line_no", "side", "line") == expected


def test_render_with_gaps(text_file):
    df = text_file("a\nx1\nb\nx2\nc\nd\ne\nx3\nf")
    found = search_lines(df, regex("x[0-9]"), limit=None, context=1)
    out = [r.output for r in lines.render_text(lines.render_rows(found, 1)).orderBy("seq").collect()]
    assert out == [
        "r/f0-1-a", "r/f0:2:x1", "r/f0-3-b",
        # Context of neighbouring matches is repeated, not merged.
        "r/f0-3-b", "r/f0:4:x2", "r/f0-5-c",
        "--",
        "r/f0-7-e", "r/f0:8:x3", "r/f0-9-f",
    ]
    plain = search_lines(df, regex("x[0-9]"), limit=None)
    kinds = [r.kind for r in lines.render_rows(plain).orderBy("seq").collect()]
    assert kinds == ["match"] * 3
    headed = lines.render_text(lines.render_rows(plain, 0, "<", ">"), columns=True, heading=True)
    assert [r.output for r in headed.orderBy("seq").collect()] == ["2:1:<x1>", "4:1:<x2>", "8:1:<x3>"]
    bare = lines.render_text(lines.render_rows(plain), line_numbers=False)
    assert [r.output for r in bare.orderBy("seq").collect()][0] == "r/f0:x1"


def test_gap_uses_the_end_of_the_last_match(spark):
    matched = spark.createDataFrame(
        [("r", "p", [(1, "a", [], ["b", "c", "d"], []), (2, "b", [], [], []), (4, "d", [], [], [])])],
        f"repo string, path string, matches {lines.MATCHES_TYPE}",
    )
    kinds = [r.kind for r in lines.render_rows(matched, context=1).orderBy("seq").collect()]
    # Line 4 lies within the first block but after the end of the second match.
    assert kinds == ["match", "context", "context", "context", "match", "separator", "match"]


def test_vimgrep(text_file):
    df = text_file("é needle\nneedle needle")
    out = rows(lines.vimgrep_rows(search_lines(df, term("needle"), limit=None)), "output")
    assert out == [("r/f0:1:4:é needle",), ("r/f0:2:1:needle needle",)]


def test_chunks(text_file):
    text = "\n".join("x" if i in (3, 5, 10, 20) else f"l{i}" for i in range(1, 21))
    df = text_file(text)
    got = rows(lines.chunk_rows(df, term("x"), 2), "first_line", "last_line", "n_matches")
    assert got == [(1, 12, 3), (18, 20, 1)]
    assert rows(lines.chunk_rows(df, term("x"), 1), "first_line", "last_line") == [(2, 6), (9, 11), (19, 20)]
    first = lines.chunk_rows(df, term("x"), 0).orderBy("first_line").first()
    assert (first.first_line, first.last_line, first.text) == (3, 3, "x")


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 3), (2, 9), (4, 5), (11, 12)], "a int, b int").withColumn("k", F.lit("f"))
    assert rows(lines.merge_intervals(df, ["k"], "a", "b"), "a", "b") == [(1, 9), (11, 12)]


def test_widths_add_up(mini):
    """The widths of all ranges count every matching line once."""
    found = search_lines(mini, term("e"), limit=None)
    width = 0
    for r in lines.range_rows(found).collect():
        first, _, last = r.range.partition("-")
        width += int(last or first) - int(first) + 1
    assert width == lines.match_rows(found).count()
