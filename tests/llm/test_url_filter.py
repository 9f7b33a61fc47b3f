from urllib.parse import urljoin

from corpusquery.llm.components import connected_components
from corpusquery.llm.queries import URL_RULES
from corpusquery.llm.url_filter import judge_urls, page_links


def judged(spark, rows, links=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    edges = None if links is None else spark.createDataFrame(links, "url string, target string")
    out = judge_urls(pages, URL_RULES, edges)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}, out


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?q#f", None, "z"),
        (2, "http://example.org/en/12", None, "z"),
        (3, "http://example.org/en/2", None, "z"),
        (4, "http://x.com/fr/1", None, "z"),
        (5, "http://x.com/de/1", None, "z"),
        (6, "http://notorg/es/", None, "z"),
        (7, "http://x.org", None, "z"),
        (8, None, None, "z"),
        (9, "no scheme/x", None, "z"),
        (10, "", None, "z"),
        (11, "http://x.com:80/de/", None, "z"),
        (12, "a://b://c.org/x", None, "z"),
    ]
    got, out = judged(spark, rows)
    assert out.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("example.org", "/en/2", "org/", "allow"),
        4: ("x.com", "/fr/1", "com/fr/", "allow"),
        5: ("x.com", "/de/1", "com/de/", "block"),
        6: ("notorg", "/es/", None, "allow"),
        7: ("x.org", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("x.com:80", "/de/", None, "allow"),
        12: ("b:", "//c.org/x", None, "allow"),
    }


def test_blocks_reach_aliases_and_spare_explicit_allows(spark):
    rows = [
        (1, "http://x.net/a", '<link rel="canonical" href="https://x.net/b">', ""),
        (2, "https://X.net/b#top", "<p>canonical</p>", ""),
        (2, "https://X.net/b#top", "<p>canonical</p>", ""),
        (3, "http://y.net/c", '<META http-equiv="refresh" content="0; url=//z.com/de/1">', ""),
        (4, "http://x.net/b", "<link href='http://y.net/c' rel='canonical'>", ""),
        (5, "http://x.org/q", '<link rel="canonical" href="http://x.net/a">', ""),
        (6, "http://other.net/", None, ""),
        (7, "http://r.net/deep/x", '<link rel="canonical" href="/root">', ""),
        (8, "http://r.net/root", "", ""),
        (9, "http://r.net/y", '<link rel="stylesheet" href="http://z.com/de/1">canonical', ""),
    ]
    got, _ = judged(spark, rows)
    assert {k: v[3] for k, v in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow",
    }


def test_targets_of_every_form(spark):
    """Against the standard library's resolution of relative references."""
    base = "https://h.net/a/b/page.html?x=1"
    targets = ["../de/2", "c.html", "./c", "?y=2", "/r/../s", "//o.net/p", "http://q.net/z", "../../../up", "..", "d/", "/", "g;x=1/./y", "../g?q=../z#../f"]
    forms = ['<link rel=canonical href={}>', "<link href='{}' rel='nofollow canonical'>", '<LINK REL="canonical" data-href="no" HREF="{}" />']
    rows = [(f"{base}&n={i}", f.format(t)) for i, (t, f) in enumerate((t, f) for t in targets for f in forms)]
    found = {r.url: r.target for r in page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    cases = [(t, f) for t in targets for f in forms]
    for i, (t, _) in enumerate(cases):
        url = f"{base}&n={i}"
        assert found[url] == urljoin(url, t), t


def test_refreshes_entities_and_other_schemes(spark):
    rows = [
        ("http://a.net/1", "<meta http-equiv=refresh content=\"0; URL='https://b.net/x?p=1&amp;q=2'\">"),
        ("http://a.net/2", "<meta content='5;url=next' http-equiv=\"Refresh\">"),
        ("http://a.net/3", '<meta http-equiv="refresh" content="30">'),
        ("http://a.net/4", '<link rel="canonical" href="mailto:x@y">'),
        ("http://a.net/5", "<link rel=canonical href=&#38;z>"),
        ("http://a.net", '<link rel="canonical" href="deep/x">'),
    ]
    found = {r.url: r.target for r in page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert {u: t for u, t in found.items() if t} == {
        "http://a.net/1": "https://b.net/x?p=1&q=2",
        "http://a.net/2": "http://a.net/next",
        "http://a.net/5": "http://a.net/&z",
        "http://a.net": "http://a.net/deep/x",
    }


def test_clashing_columns(spark):
    ddl = "url string, html string, alias string, _blocked int, mix int, own int, fit int, blocked string, `a.b` int"
    pages = spark.createDataFrame([("http://x.com/de/1", None, "a", 1, 2, 3, 4, "b", 5)], ddl)
    out = judge_urls(pages, URL_RULES)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert tuple(out.first()) == (*pages.first(), "x.com", "/de/1", "com/de/", "block")


def test_links_given_as_a_table_and_empty_tables(spark):
    rows = [(1, "http://a.net/", None, ""), (2, "http://b.net/", None, "")]
    got, _ = judged(spark, rows, [("http://a.net/", "http://k.com/de/"), (None, "http://b.net/"), ("x", None)])
    assert (got[1][3], got[2][3]) == ("block", "allow")
    assert judged(spark, [])[0] == {}


def test_page_links_of_long_pages(spark):
    html = "<p>word</p>" * 50_000 + '<link rel=canonical href="http://b.net/">'
    pages = spark.createDataFrame([("http://a.net/", html)], "url string, html string")
    assert [r.target for r in page_links(pages).collect()] == ["http://b.net/"]


def test_components_of_a_chain_a_hub_and_pairs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(1, i) for i in range(2, 60)]
    edges = chain + hub + [(900, 901), (901, 900), (7, 7), (None, 3), (5, None)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in out.collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}, 900: 900, 901: 900}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
