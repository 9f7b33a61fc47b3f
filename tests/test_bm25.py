"""Ranking by BM25 from the word index."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from corpusquery.operators import blocks, bm25


def brute(rows, words, k):
    texts = [(r[0], r[1], re.findall(r"[^\W_]+", (r[2] or "").lower())) for r in rows]
    average = max(1.0, sum(len(t) for *_, t in texts) / max(1, len(texts)))
    asked = {w.lower() for w in words}
    df = {w: sum(w in t for *_, t in texts) for w in asked}
    out = []
    for repo, path, text in texts:
        score = 0.0
        for w in sorted(asked):
            tf = text.count(w)
            if tf:
                weight = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                score += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(text) / average))
        if round(score, 6) > 0:
            out.append((-round(score, 6), repo, path))
    return [(repo, path, -score) for score, repo, path in sorted(out)[:k]]


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"r{i % 4}", f"f{i:03d}", " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 30, 90])))) for i in range(300)]
    # The best files for a rare word stand together, as neighbours in a folder would.
    rows += [("z", f"g{i}", "rare word " * (i + 1)) for i in range(12)]
    return rows + [("q", "none", None), ("q", "empty", ""), ("q", "same1", "W7 w8 É"), ("q", "same2", "w7 w8 é")]


def test_ranking_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    files = spark.createDataFrame(rows, "repo string, path string, content string").coalesce(1)
    shown = lambda df: [tuple(r) for r in df.collect()]
    whole = bm25.build_word_index(files)
    monkeypatch.setattr(blocks, "RUN_FILES", 20)
    small = bm25.build_word_index(files)
    monkeypatch.setattr(bm25, "FIRST_RUNS", 1)
    for words, k in ((["w0", "W3", "w3"], 5), (["rare"], 4), (["w7", "é"], 3), (["w0", "w59", "nowhere"], 50), (["nowhere"], 5)):
        assert shown(bm25.top_files_bm25(whole, words, k)) == brute(rows, words, k)
        assert shown(bm25.top_files_bm25(small, words, k)) == brute(rows, words, k)


def test_runs_out_of_reach_are_not_read(spark, monkeypatch):
    rows = corpus()
    files = spark.createDataFrame(rows, "repo string, path string, content string").coalesce(1)
    monkeypatch.setattr(blocks, "RUN_FILES", 12)
    monkeypatch.setattr(bm25, "FIRST_RUNS", 1)
    built, left = bm25.build_word_index(files), []
    original = bm25.reachable
    monkeypatch.setattr(bm25, "reachable", lambda *a: left.append(original(*a)) or left[-1])
    found = bm25.top_files_bm25(built, ["word", "w1"], 5).collect()
    assert [r.path for r in found] == [p for _, p, _ in brute(rows, ["word", "w1"], 5)]
    assert left[0].count() < built.blocks.where("word IN ('word', 'w1')").select("run").distinct().count() // 2


def test_no_files(spark):
    empty = bm25.build_word_index(spark.createDataFrame([], "repo string, path string, content string"))
    assert bm25.top_files_bm25(empty, ["a"]).collect() == []


def test_postings_of_a_run_are_gathered_as_numbers():
    rng = random.Random(4)
    texts = [[f"w{int(rng.paretovariate(0.5)) % 500}" for _ in range(rng.randint(0, 80))] for _ in range(60)] + [None, []]
    names = pa.RecordBatch.from_arrays([pa.array(["r"] * len(texts)), pa.array([str(i) for i in range(len(texts))])], names=["repo", "path"])
    run, found = bm25._Run(), bm25._Found(pa.array(texts, pa.list_(pa.string())))
    for begin, end in ((0, 25), (25, len(texts))):
        run.add(names.slice(begin, end - begin), found, begin, end)
    assert run.postings == sum(len(set(t or ())) for t in texts)
    assert sum(c.nbytes for part in run.parts for c in part) == 12 * run.postings
    sizes = np.concatenate(run.lengths)
    assert sizes.tolist() == [len(t or ()) for t in texts]
    got = {}
    for part in run.blocks(3, sizes):
        for i, word in enumerate(part["word"]):
            at, _ = blocks.decode([(part["n"][i], part["first"][i], part["numbers"][i].as_py())])
            counts = blocks.unpack_numbers(part["counts"][i].as_py())
            got |= {(word, a): c for a, c in zip(at.tolist(), counts.tolist())}
            assert part["most"][i] == counts.max() and part["least"][i] == sizes[at].min()
    assert got == {(w, i): t.count(w) for i, t in enumerate(texts) if t for w in set(t)}
