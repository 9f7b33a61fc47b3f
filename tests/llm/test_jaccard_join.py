import random
import re

import numpy as np
import pytest

from corpusquery.llm import jaccard_join
from corpusquery.llm.jaccard_join import one_per_group, similarity_classes, tile_links
from corpusquery.plans import joins


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), smallest[root(i)]) for i, (doc_id, _) in enumerate(rows))


def corpus(seed=1, copies=30):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz") * rng.randrange(3)
    fresh = lambda n: [f"{word()}{rng.randrange(3000)}" for _ in range(n)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three four", "É é", "é é"]
    common = fresh(30)
    for n in (5, 6, 7, 9, 12, 25, 60, 150, 400):
        base = fresh(n)
        for _ in range(copies if n in (25, 60) else 6):
            near = list(base)
            for _ in range(rng.randrange(max(2, n // 20))):
                at = rng.randrange(len(near))
                near[at : at + rng.randrange(2)] = fresh(rng.randrange(3))
            texts.append(" ".join(near))
        texts += [" ".join(base), " ".join(base).upper()]
    texts += [" ".join(common + fresh(n)) for n in (1, 2, 3, 4, 5, 6, 8, 40, 200) for _ in range(4)]
    chain = fresh(80)
    for k in range(12):  # each links with the next only
        texts.append(" ".join(chain[k * 4 :] + [f"tail{x}" for x in range(k * 4)]))
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS component_id", "1 AS b").repartition(5)
    out = similarity_classes(docs)
    assert out.columns == ["doc_id", "b", "n_shingles", "component_id"]
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())


def test_components_agree_with_all_pairs(spark):
    rows = corpus()
    assert result(spark, rows) == expected(rows)


def test_steps_stay_in_their_rows_whatever_the_size(spark, monkeypatch):
    """Beyond 200,000 sets a join moved the steps of all of them, and they were written twice."""
    moved, plain = [], jaccard_join.join_by_size
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(
        jaccard_join, "join_by_size", lambda a, b, *more, **named: (moved.append({*a.columns, *b.columns}), plain(a, b, *more, **named))[1]
    )
    rows = corpus(seed=4, copies=4)
    rows += [(1000 + i, t) for i, t in rows]
    assert result(spark, rows) == expected(rows)
    assert moved and not any(m & {"rare", "often"} for m in moved)


def test_copies_in_a_task_have_no_steps(spark):
    rows = [(k, 7 * k, 9 * k, t) for k, t in enumerate(["a b c d e f g"] * 3 + ["b c d e f g h", None, "", "a b"] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, row long, row2 long, text string").coalesce(1)
    frequent = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    got = {r.doc_id: r for r in jaccard_join.shingle_sets(docs, frequent).collect()}
    assert [len(got[k].rare) > 0 for k in range(11)] == [True, False, False, True] + [False] * 7
    assert got[0].key == got[1].key == got[2].key != got[3].key == got[7].key and got[4].key is None


@pytest.mark.parametrize("block, frequent", [(400, 10**6), (3000, 40)])
def test_many_blocks_and_frequent_tokens_change_nothing(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", frequent)
    rows = corpus(seed=block)
    assert result(spark, rows) == expected(rows)


def test_linked_sets_share_a_step():
    rng = np.random.default_rng(5)
    tried = 0
    for _ in range(20_000):
        n = rng.integers(2, 30)
        x = np.unique(rng.integers(0, 200, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(x.size) > 0.15], rng.integers(0, 200, rng.integers(0, 4)).astype(np.uint64))))
        both = np.intersect1d(x, y).size
        if x.size == y.size == both or not jaccard_join.linked(both, x.size, y.size):
            continue
        tried += 1
        often = np.unique(rng.integers(0, 200, rng.integers(0, 150)).astype(np.uint64))
        of = [np.concatenate(jaccard_join.steps(s, often)) for s in (x, y)]
        assert np.intersect1d(*of).size, (x, y, often)
    assert tried > 1000


def test_tile_links_join_what_all_pairs_join():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.integers(0, 2**63, 30).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(30) < rng.choice([0.02, 0.08]), rng.integers(0, 2**63, 30).astype(np.uint64), base)) for _ in range(12)]
        names = list(range(12))
        links = tile_links(names, sets, names, [True] * 12)
        rows = [(i, " ".join(f"{x}" for x in s)) for i, s in enumerate(sets)]
        label = {i: i for i in names}
        for a, b in links:
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
        for i, j in ((i, j) for i in names for j in names):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * both >= 80 * (sets[i].size + sets[j].size - both):
                assert label[i] == label[j], rows
        assert len(links) == 12 - len(set(label.values()))


def test_one_document_of_each_group_stays(spark):
    rows = corpus(seed=9, copies=8)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, extra string")
    again = docs.where("doc_id % 3 = 0")
    other = spark.createDataFrame([(5, "five other words of text", "y"), (None, "an id that is missing here", "z")], docs.schema)
    kept = one_per_group(docs.unionByName(again).unionByName(other))
    assert kept.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.where("text IS NOT NULL AND btrim(text, ' \n') <> ''").collect())
    firsts = {c for _, n, c in expected(rows) if n}
    assert got == sorted([*firsts, 5, -1])
    assert kept.where("text IS NULL").count() == docs.unionByName(again).where("text IS NULL").count()
    assert one_per_group(docs.limit(0)).collect() == []
