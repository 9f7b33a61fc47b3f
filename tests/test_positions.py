"""Candidates by grams at the right distance."""

import random

import pytest

from corpusquery.operators import blocks, index, positions

ALPHABET = "abcé \nX😀"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 80))) for _ in range(90)] + [None, "", "ab"]


@pytest.mark.parametrize("runs", [7, 1 << 16])
def test_between_the_truth_and_the_candidates(spark, texts, monkeypatch, runs):
    monkeypatch.setattr(positions, "RUN_FILES", runs)
    monkeypatch.setattr(positions, "RUN_POSITIONS", runs * 100)
    files = spark.createDataFrame([("r", f"f{i}", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    asked = [t[3:9] for t in texts if t and len(t) > 9][:40] + ["abc", "ab", "a", "", "abcabc", "XX", "😀é"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, text string")
    pairs = lambda df: {(r.query_id, r.path) for r in df.collect()}
    near = index.candidates(blocks.build_gram_index(files), queries)
    found = pairs(positions.candidates_positional(near, positions.build_position_index(files), queries))
    folded = [(t or "").lower() for t in texts]
    truth = {(q, f"f{i}") for q, a in enumerate(asked) for i, t in enumerate(folded) if a and a.lower() in t}
    assert truth <= found <= pairs(near)
    ends = lambda a, t: any(
        t[i : i + 3] == a[:3] and t[i + len(a) - 3 : i + len(a)] == a[-3:] for i in range(len(t) - len(a) + 1)
    )
    expected = {(q, p) for q, p in pairs(near) if len(asked[q]) < 3 or ends(asked[q].lower(), folded[int(p[1:])])}
    assert found == expected and len(found) < len(pairs(near))


def test_places_are_those_of_the_text(spark, texts):
    files = spark.createDataFrame([("r", f"f{i}", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    built = positions.build_position_index(files.coalesce(1))
    names = {(r.run, r.at): r.path for r in built.files.collect()}
    got = set()
    for r in built.blocks.collect():
        for place in positions._places(r.asDict()).tolist():
            got.add((r.gram, names[r.run, place >> 32], place & 0xFFFFFFFF))
    folded = [(t or "").lower() for t in texts]
    assert got == {(t[i : i + 3], f"f{k}", i) for k, t in enumerate(folded) for i in range(len(t) - 2)}


def test_a_text_is_looked_for_only_in_the_runs_of_its_candidates(spark, texts, monkeypatch):
    """Blocks are shuffled once, whatever the number of queries that share their grams."""
    monkeypatch.setattr(positions, "RUN_FILES", 7)
    monkeypatch.setattr(positions, "RUN_POSITIONS", 700)
    monkeypatch.setattr(positions, "QUERIES_AT_ONCE", 3)
    files = spark.createDataFrame([("r", f"f{i}", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    asked = [t[3:9] for t in texts if t and len(t) > 9][:20]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, text string")
    built = positions.build_position_index(files.coalesce(1))
    every = {(r.query_id, r.path) for r in positions.files_at_distance(built, queries).collect()}
    one = spark.createDataFrame([(0, "r", "f0"), (1, "r", "f50")], "query_id bigint, repo string, path string")
    found = {(r.query_id, r.path) for r in positions.files_at_distance(built, queries, one).collect()}
    run = {r.path: r.run for r in built.files.collect()}
    assert found == {(q, p) for q, p in every if (q, run[p]) in {(0, run["f0"]), (1, run["f50"])}}
