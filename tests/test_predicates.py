"""The worked query examples and the composition rules of predicates."""

import pytest

from corpusquery import (
    archived, branch, case_sensitive, fork, lang, path, phrase, public, regex, repo, search, search_lines,
    sym, term,
)
from corpusquery.operators.search import list_repos, matching_files
from corpusquery.operators.symbols import SymbolRule, extract_symbols
from corpusquery.plans import joins
from corpusquery.plans.predicates import Demand, is_repo_only, required_terms

MAIN, A, X, Y, Z = "src/Main.java", "src/a.c", "x.py", "y.py", "z.txt"

EXAMPLES = [
    ("needle", term("needle"), {MAIN, A, X}),
    ("thread or needle", term("thread") | term("needle"), {MAIN, A, X}),
    ("class needle", term("class") & term("needle"), {MAIN, X}),
    ("class Needle", term("class") & term("Needle"), {MAIN}),
    ("class Needle case:yes", case_sensitive(term("class") & term("Needle")), {MAIN}),
    ("Class case:yes", case_sensitive(term("Class") | term("PATH")), set()),
    ("needle case:yes", case_sensitive(term("needle")), {A, X}),
    ("phrase", phrase("class Needle"), {MAIN}),
    ("needle -hay", term("needle") & ~term("hay"), {MAIN, A}),
    ("path file:java", term("path") & path("java"), {MAIN}),
    ("needle lang:python", term("needle") & lang("Python"), {X}),
    (r"f:\.c$", path(r"\.c$"), {A}),
    ("path -file:java", term("path") & ~path("java"), {Y, Z}),
    ("foo.*bar", regex("foo.*bar"), {Y}),
    ("-(Path File) Stream", ~(term("Path") & term("File")) & term("Stream"), {Y}),
    (r"-Path\ file Stream", ~phrase("Path file") & term("Stream"), {Z}),
    ("phone r:droid", term("phone") & repo("droid"), set()),
    ("phone r:go", term("phone") & repo("go"), {X, Y}),
    ("phone archived:no", term("phone") & archived(False), {X}),
    ("phone fork:no", term("phone") & fork(False), {Y}),
    ("phone public:no", term("phone") & public(False), {X}),
    ("phone b:master", term("phone") & branch("master"), {X}),
    ("phone b:HEAD", term("phone") & branch("HEAD"), {X, Y}),
    ("stream b:HEAD", term("stream") & branch("HEAD"), {MAIN, Y}),
]


def test_worked_examples(mini):
    columns = [p.column().alias(f"e{i}") for i, (_, p, _) in enumerate(EXAMPLES)]
    rows = mini.select("path", *columns).collect()
    for i, (name, _, expected) in enumerate(EXAMPLES):
        assert {r.path for r in rows if r[f"e{i}"]} == expected, name


def test_flags_from_repos_table(mini, mini_repos):
    bare = mini.drop("archived", "fork", "public")
    predicate = term("phone") & (archived(True) | fork(True)) & ~public(True)
    found = matching_files(bare, predicate, repos=mini_repos)
    assert [r.path for r in found.collect()] == [X]
    assert found.columns == bare.columns
    with pytest.raises(ValueError):
        matching_files(bare, archived(True))


def test_repo_lists(mini, mini_repos):
    names = lambda df: [r.repo for r in df.collect()]
    assert names(list_repos(mini, repo("go"), mini_repos)) == ["empty/go", "google/go", "lib/go"]
    assert names(list_repos(mini, repo("go") & ~repo("google"), mini_repos)) == ["empty/go", "lib/go"]
    # With a content term the repository comes from its files.
    assert names(list_repos(mini, term("needle"), mini_repos)) == ["droid/app", "google/go"]
    assert names(search(mini, repo("droid"), repos=mini_repos)) == ["droid/app"]


def test_repo_only_rule():
    assert is_repo_only(repo("a") & ~repo("b"))
    assert not is_repo_only(repo("a") & path("b"))
    assert not is_repo_only(repo("a") & archived(False))


RULES = [
    SymbolRule("java", "class", "class ", r"\w+"),
    SymbolRule("python", "class", "^class ", r"\w+"),
    SymbolRule("python", "field", "^  ", r"\w+", " =", parent_kind="class"),
]


@pytest.mark.parametrize("small", [True, False])
def test_symbol_atoms(mini, monkeypatch, small):
    if not small:
        monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    symbols = extract_symbols(mini, RULES)
    found = lambda p: {r.path for r in matching_files(mini, p, symbols=symbols).collect()}
    assert found(sym("needle")) == {MAIN, X}
    assert found(sym("Needle")) == {MAIN}
    assert found(sym("needle") & ~term("hay")) == {MAIN}
    assert found(~sym("needle")) == {A, Y, Z}
    assert found(sym("phone") | term("thread")) == {X, A}


def test_symbol_rows(mini):
    rows = extract_symbols(mini, RULES).orderBy("repo", "path", "line_no", "pos").collect()
    assert [tuple(r)[2:] for r in rows] == [
        (1, 1, "Needle", "class", None, None, 6, 6),
        (1, 1, "needle", "class", None, None, 6, 6),
        (2, 1, "phone", "field", "needle", "class", 2, 5),
        (3, 1, "hay", "field", "needle", "class", 2, 3),
    ]


def test_symbol_offsets_in_a_line_that_repeats_the_name(text_file):
    df = text_file("é class class, class b")
    rule = SymbolRule("text", "class", "class ", r"\w+")
    rows = extract_symbols(df, [rule]).orderBy("pos").collect()
    assert [(r.sym, r.off, r.len) for r in rows] == [("class", 9, 5), ("b", 22, 1)]


@pytest.mark.parametrize("limit", [None, 1, 0])
def test_symbol_search_shows_definition_lines(mini, limit):
    """A symbol atom selects the lines of its definitions, with their details."""
    symbols = extract_symbols(mini, RULES)
    found = search_lines(mini, sym("ha") | term("thread"), symbols=symbols, limit=limit)
    rows = {(r.path, m.line_no): m for r in found.collect() for m in r.matches}
    # Equal scores: the cap of one keeps the first repository.
    assert set(rows) == ({(A, 1)} if limit == 1 else {(A, 1), (X, 3)})
    if limit != 1:
        (fragment,) = rows[(X, 3)].fragments
        assert (fragment.off, fragment.len) == (2, 3)
        assert tuple(fragment.symbol) == ("hay", "field", "needle", "class")
        assert rows[(A, 1)].fragments[0].symbol is None
    texts = {r.text for r in search(mini, sym("needle"), symbols=symbols).collect()}
    assert texts == {"class Needle {", "class needle:"}
    both = search_lines(mini, sym("needle") & term("class"), symbols=symbols, limit=None)
    assert sorted(r.score for r in both.collect()) == [2, 2]
    assert all(len(r.matches) == 1 and len(r.matches[0].fragments) == 2 for r in both.collect())


def test_null_content_never_matches(spark):
    df = spark.createDataFrame(
        [("r", "a", None), ("r", "b", "hay")], "repo string, path string, content string"
    )
    paths = lambda p: sorted(r.path for r in matching_files(df, p).collect())
    assert paths(term("hay")) == ["b"]
    assert paths(~term("hay")) == ["a"]
    assert paths(~~term("hay")) == ["b"]


def test_metamorphic(mini):
    n = lambda p: matching_files(mini, p).count()
    a, b = term("path"), regex("st.eam")
    assert n(a & b) <= min(n(a), n(b))
    assert n(a) + n(~a) == mini.count()
    assert n(a | b) == n(a) + n(b) - n(a & b)
    assert n(~(a & b)) == n(~a | ~b)


def test_case_folding_beyond_ascii(text_file):
    df = text_file("Étion", "étion", "etion")
    for p in (term("étion"), regex("ét.on")):
        assert matching_files(df, p).count() == 2
    assert matching_files(df, term("Étion")).count() == 1


def test_literals_are_not_patterns(text_file):
    df = text_file(r"a.b \E* (x", "axb")
    for text in (".b", r"\E*", "(x"):
        assert matching_files(df, term(text)).count() == 1
        assert search(df, term(text), limit=None).count() == 1


def test_only_newline_ends_a_line(text_file):
    df = text_file("one\u2028two\rthree", "two")
    assert matching_files(df, regex("^two")).count() == 1
    assert matching_files(df, regex("one.two.three$")).count() == 1


def test_required_terms():
    abc, xyz, uvw = (Demand("text", text=t) for t in ("abc", "xyz", "uvw"))
    assert required_terms(term("abc") & term("de")) == abc
    assert required_terms(term("abc") | term("de")) is None
    assert required_terms((term("abc") | term("xyz")) & term("uvw")) == Demand("all", (Demand("any", (abc, xyz)), uvw))
    assert required_terms(regex("abc.*xyz")) == Demand("all", (abc, xyz))
    assert required_terms(regex("a.*b") | term("abc")) is None
    assert required_terms(~term("abc")) is None
    assert required_terms(lang("c") & ~term("abc")) is None


def test_bad_input():
    with pytest.raises(ValueError):
        term("")
    with pytest.raises(ValueError):
        regex("")


def test_missing_flags_are_false(spark):
    files = spark.createDataFrame([("r", "a", None, None, None)], "repo string, path string, archived boolean, fork boolean, public boolean")
    for predicate in (archived(False), ~archived(True), fork(False), public(False)):
        assert files.where(predicate.column()).count() == 1


def test_sigma_folds_alike_everywhere(spark):
    from corpusquery.operators.blocks import build_gram_index
    from corpusquery.operators.index import candidates, narrow_files

    rows = [("r", "a", "η ΟΔΟΣ"), ("r", "b", "ΟΔΟΣΧ οδός"), ("r", "c", "οδος"), ("r", "d", "none")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    found = lambda df: {r.path for r in df.collect()}
    predicate = term("οδος")
    scanned = found(files.where(predicate.column()))
    assert scanned == {"a", "b", "c"}
    built = build_gram_index(files)
    assert found(narrow_files(files, built, predicate).where(predicate.column())) == scanned
    queries = spark.createDataFrame([(1, "ΟΔΟΣ")], "query_id int, text string")
    assert found(candidates(built, queries)) >= scanned
