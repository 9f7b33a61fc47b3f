"""Modes, envelope, ranking, caps, duplicates and repository statistics."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusquery import envelope, get_file, get_files, regex, search, search_lines, term
from corpusquery.operators import repos, results
from corpusquery.operators import search as searching
from corpusquery.operators.blocks import build_gram_index
from corpusquery.operators.search import (
    attach_repos, envelope_of, list_files, matching_files, result_json, score_files, top_files,
)
from corpusquery.plans import joins


def keys(df):
    return [(r.repo, r.path) for r in df.collect()]


def test_files_mode_and_envelope(spark):
    files = spark.createDataFrame(
        [("repo", "b.go", "func"), ("repo", "a.go", "func"), ("repo", "c.go", "x")],
        "repo string, path string, content string",
    )
    names = [r.file for r in search(files, term("func"), mode="files").collect()]
    assert names == ["repo:a.go", "repo:b.go"]
    found = matching_files(files, term("func"))
    assert tuple(envelope(found).first()) == (2, 2, False)
    assert tuple(envelope(found, 1).first()) == (2, 1, True)
    assert tuple(envelope(found, None).first()) == (2, 2, False)
    assert tuple(envelope(matching_files(files, term("none"))).first()) == (0, 0, False)
    # A total that is not known falls back to what was returned.
    assert tuple(envelope_of(found, 0).first()) == (2, 2, False)
    assert tuple(envelope_of(found, 7).first()) == (7, 2, True)
    with pytest.raises(ValueError):
        search(files, term("func"), mode="words")


def test_names_in_byte_order(spark):
    scored = spark.createDataFrame([("b", "x"), ("B", "x"), ("é", "x"), ("b", "x")], "repo string, path string")
    assert [r.file for r in list_files(scored, "/").collect()] == ["B/x", "b/x", "é/x"]


def test_repos_mode_ignores_the_cap(spark):
    files = spark.createDataFrame(
        [(f"r{i % 3}", f"f{i}", "hit") for i in range(200)], "repo string, path string, content string"
    )
    assert [r.repo for r in search(files, term("hit"), mode="repos", limit=1).collect()] == ["r0", "r1", "r2"]
    assert search(files, term("hit"), mode="files").count() == 50
    assert search(files, term("hit"), mode="files", limit=None).count() == 200
    assert search_lines(files, term("hit"), limit=7).count() == 7


def test_top_files_have_a_total_order(spark):
    files = spark.createDataFrame(
        [("r", "b", "x x"), ("r", "a", "x x"), ("q", "z", "x x"), ("r", "c", "x x x"), ("r", "d", "x")],
        "repo string, path string, content string",
    )
    ranked = top_files(score_files(files, term("x")), 4)
    assert [tuple(r) for r in ranked.collect()] == [("r", "c", 3), ("q", "z", 2), ("r", "a", 2), ("r", "b", 2)]
    lines = search_lines(files, term("x"), limit=2)
    assert sorted(keys(lines)) == [("q", "z"), ("r", "c")]


def test_score_counts_fragments(text_file):
    df = text_file("xx x\nxxx", "a\nb")
    predicate = regex("x+") | term("xx")
    scored = score_files(df, predicate).orderBy("path").collect()
    found = search_lines(df, predicate, limit=None)
    from corpusquery.operators.lines import fragment_rows

    assert [r.score for r in scored] == [5, 0]
    assert fragment_rows(found).count() == 5


def test_total_cap(spark):
    scored = spark.createDataFrame(
        [("r", "a", 5), ("r", "b", 3), ("r", "c", 3), ("r", "d", 1), ("r", "e", 0)],
        "repo string, path string, score bigint",
    )
    cut = lambda cap: [p for _, p in keys(results.total_cap(scored, cap).orderBy(F.desc("score"), "path"))]
    # The file that crosses the cap is the last one; files without a match stay.
    assert cut(8) == ["a", "b", "e"]
    assert cut(9) == ["a", "b", "c", "e"]
    assert cut(4) == ["a", "e"]
    assert cut(100) == ["a", "b", "c", "d", "e"]
    names_only = scored.withColumn("score", F.lit(0).cast("bigint"))
    assert results.total_cap(names_only, 1).count() == 5


def test_match_cap_per_repo(spark):
    scored = spark.createDataFrame(
        [("r", "a", 5), ("r", "b", 3), ("r", "c", 3), ("s", "d", 9), ("s", "e", 0), ("t", "f", 1)],
        "repo string, path string, score bigint",
    )
    cut = lambda cap: {p for _, p in keys(results.per_repo_match_cap(scored, cap))}
    assert cut(5) == {"a", "d", "e", "f"}
    assert cut(6) == {"a", "b", "d", "e", "f"}
    assert cut(99) == {"a", "b", "c", "d", "e", "f"}


def test_per_repo_cap_with_a_hot_repo(spark):
    scored = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 7).cast("string"))).alias("repo"),
        F.col("id").cast("string").alias("path"),
        (F.col("id") % 100).alias("score"),
    )
    kept = results.per_repo_cap(scored, 2)
    per_repo = {r.repo: r.n for r in kept.groupBy("repo").agg(F.count("*").alias("n")).collect()}
    assert per_repo["hot"] == 2 and set(per_repo.values()) == {2}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # before and after each of two shuffles
    # Caps beyond Spark's own limit are cut in parts as well.
    assert results.per_repo_cap(scored, 1500).where("repo = 'hot'").count() == 1500


@pytest.mark.parametrize("limit", [None, 0])
def test_duplicates_with_a_hot_content(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", limit)
        monkeypatch.setattr(results, "HOT_COPIES", 100)
    rng = random.Random(5)
    data = [
        (f"r{i % 4}", f"f{i}", rng.randint(0, 3), "same" if i % 3 == 0 else f"t{i % 50}") for i in range(400)
    ]
    df = spark.createDataFrame(data, "repo string, path string, score bigint, content_sha string")
    got = {(r.repo, r.path): r.duplicate_of for r in results.mark_duplicates(df).collect()}
    best = {}
    for row in sorted(data, key=lambda r: (-r[2], r[0], r[1])):
        best.setdefault(row[3], row[:2])
    expected = {r[:2]: None if best[r[3]] == r[:2] else ":".join(best[r[3]]) for r in data}
    assert got == expected


def test_stats(text_file):
    df = text_file("x x", "x", "y")
    scored = score_files(matching_files(df, term("x")), term("x"))
    assert tuple(results.search_stats(scored).first()) == (2, 3)
    assert tuple(results.search_stats(scored.where("false")).first()) == (0, 0)


def test_repo_statistics(spark):
    files = spark.createDataFrame(
        [("a", "1", "é"), ("a", "2", "xx"), ("b", "1", "")], "repo string, path string, content string"
    )
    entries = spark.createDataFrame(
        [("a", 0, 10), ("a", 0, 5), ("a", 1, 1)], "repo string, shard int, index_bytes bigint"
    )
    stats = repos.repo_stats(files, entries).orderBy("repo").collect()
    assert [tuple(r) for r in stats] == [("a", 2, 4, 2, 16), ("b", 1, 0, 0, 0)]
    assert tuple(repos.corpus_totals(files).first()) == (2, 3, 4)
    assert tuple(repos.corpus_totals(files.where("false")).first()) == (0, 0, 0)
    listing = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none")], "id int, repo string")
    by_id = {r.id: tuple(r.entry) for r in repos.repo_map(listing, repos.repo_stats(files)).collect()}
    assert by_id == {1: ("a", 2, 4), 2: ("b", 1, 0), 3: ("none", 0, 0)}


def test_repo_listing(spark):
    files = spark.createDataFrame([("a", "1", "é")], "repo string, path string, content string")
    entries = spark.createDataFrame(
        [("a", 0, 10, 3), ("a", 1, 5, 9)], "repo string, shard int, index_bytes bigint, indexed_at int"
    )
    listing = spark.createDataFrame([(1, "a"), (2, "empty")], "id int, repo string")
    symbols = spark.createDataFrame([("a", "x"), ("a", "y")], "repo string, sym string")
    rows = repos.repo_listing(listing, repos.repo_stats(files, entries), symbols).orderBy("id").collect()
    assert rows[0].asDict() == {
        "id": 1, "repo": "a", "documents": 1, "content_bytes": 2, "shards": 2, "index_bytes": 15,
        "index_time": 9, "has_symbols": True,
    }
    assert (rows[1].documents, rows[1].index_time, rows[1].has_symbols) == (0, None, False)


@pytest.mark.parametrize(
    "order,expected",
    [
        ("name", "abc"), ("revname", "cba"), ("time", "bca"), ("revtime", "acb"),
        ("size", "acb"), ("revsize", "bac"), ("ram", "cab"), ("revram", "bac"),
    ],
)
def test_repo_orders(spark, order, expected):
    listing = spark.createDataFrame(
        [("a", 3, 1, 5), ("b", 1, 2, 9), ("c", 2, 1, 4)],
        "repo string, index_time int, content_bytes bigint, index_bytes bigint",
    )
    assert "".join(r.repo for r in repos.order_repos(listing, order).collect()) == expected


def test_unknown_order(spark):
    with pytest.raises(ValueError):
        repos.order_repos(spark.createDataFrame([("a",)], "repo string"), "speed")


def test_json_document(text_file):
    df = text_file("x\nx\ny\nx", "y", "x")
    found = search_lines(df, term("x"), limit=50)
    document = json.loads(result_json(found, total=9, limit=50).first().json)
    assert document == {
        "total_matches": 9,
        "returned": 2,
        "truncated": True,
        "results": {"r:f0": {"1-2": "x\nx", "4": "x"}, "r:f2": {"1": "x"}},
    }


def test_get_file(spark, mini):
    assert get_file(mini, "lib/go", "z.txt").first().content == "Path File\nStream"
    assert get_file(mini, "lib/go", "z.txt", offset=1).first().content == "Stream"
    # Names are literal, not patterns.
    assert get_file(mini, "lib.go", "z.txt").count() == 0
    wanted = spark.createDataFrame(
        [("lib/go", "y.py"), ("lib/go", "y.py"), ("lib/go", "none")], "repo string, path string"
    )
    assert keys(get_files(mini, wanted)) == [("lib/go", "y.py")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    big = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"), F.col("id")
    )
    small = spark.range(0, 8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    run = lambda rows: sorted(
        map(tuple, joins.join_by_size(big, small, ["k"], how, ["id"], max_rows=rows).collect()), key=str
    )
    assert run(100) == run(0)
    plan = joins.join_by_size(big, small, ["k"], how, ["id"], max_rows=0)
    assert "_salt" not in plan.columns
    with pytest.raises(ValueError):
        joins.join_by_size(big, small, ["k"], "full", ["id"])


def test_size_check_looks_at_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 5, "t string")
    assert joins.is_small(df, 10, 10_000)
    assert not joins.is_small(df, 4, 10_000)
    assert not joins.is_small(df, 10, 1_000)


def test_attach_repos_keeps_every_file(mini, mini_repos):
    joined = attach_repos(mini.select("repo", "path"), mini_repos.where("repo <> 'lib/go'"), ["public"])
    assert joined.count() == mini.count()


def test_capped_search_opens_the_files_of_its_results_only(spark, tmp_path, monkeypatch):
    rows = [("r", f"f{i:03d}", "needle\n" * (i % 40) + "hay") for i in range(120)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    files.repartitionByRange(12, "path").write.parquet(f"{tmp_path}/files")
    stored = spark.read.parquet(f"{tmp_path}/files")
    again = []
    original = searching.fetch
    monkeypatch.setattr(searching, "fetch", lambda f, k: again.append(original(f, k)) or again[-1])
    shown = lambda df: sorted(map(str, df.select("repo", "path", "score", "matches").collect()))
    found = search_lines(stored, term("needle"), limit=2)
    expected = search_lines(files, term("needle"), limit=2)
    assert shown(found) == shown(expected)
    # Both best files lie in one data file each; the others are not opened.
    with_conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = again[0].select("path")._jdf.queryExecution()
        plan.toRdd().count()
        scans = plan.executedPlan().collectLeaves()
        read = [scans.apply(i).metrics().apply("numFiles").value() for i in range(scans.size()) if "files" in scans.apply(i).toString()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_conf)
    assert max(read) <= 2
    assert len(again) == 1  # a table that is no file has no places
    built = build_gram_index(stored)
    assert shown(search_lines(stored, term("needle"), index=built, limit=2)) == shown(expected)


def test_latest_entry_of_an_id(spark):
    listed = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 1)], "id int, repo string, at int")
    stats = spark.createDataFrame([("a", 5, 6)], "repo string, documents long, content_bytes long")
    of = lambda df: {r.id: tuple(r.entry) for r in df.collect()}
    assert of(repos.repo_map(listed, stats, "at")) == {1: ("a", 5, 6), 2: ("c", 0, 0)}
    assert of(repos.repo_map(listed, stats)) == {1: ("b", 0, 0), 2: ("c", 0, 0)}
