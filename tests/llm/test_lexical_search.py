import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusquery.llm import lexical_search
from corpusquery.llm.lexical_search import rank_documents, terms
from corpusquery.plans import joins

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    """Every item against every document."""
    found = [(doc_id, Counter(plain_terms(text)), len(plain_terms(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in found), sum(n for *_, n in found)
    df = Counter(t for _, tf, _ in found for t in tf)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in found:
            score = 0
            for t in plain_terms(text):
                if tf[t]:
                    m = 100 - 75 + ((75 * n * n_docs) // n_terms)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=str)


def ranking(spark, docs, items, k=10, partitions=3):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, Shard int")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, bundle int")
    return sorted(map(tuple, rank_documents(d.repartition(partitions), i, k).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    common = [1 / (i + 1) for i in range(400)]  # the first words are in most documents
    docs = [(i, " ".join(chance.choices(words, common, k=chance.choice([1, 5, 40, 300])))) for i in range(600)]
    docs += [(600, None), (601, ""), (602, "-- ..."), (None, "w1 W1 w300"), (5, "w300 w5"), (5, "w300 w5")]
    docs += [(700 + i, "Größe w7 w399 copied text") for i in range(30)]  # ties
    items = [(i, " ".join(chance.choices(words, k=12))) for i in range(40)]
    items += [(40, "größe GRÖSSE Größe w399"), (41, None), (42, "nowhere"), (43, "w0 w0 w1"), (None, "w3"), (0, "w9"), (0, "w9")]
    items.append((50, docs[17][1]))
    return docs, items


def test_terms_are_the_matches_of_the_pattern():
    chance = random.Random(1)
    alphabet = "aZ09 -_./:@[`{|~\n\t\x00\x7f\x80 éÉß日😀"
    for _ in range(500):
        text = "".join(chance.choices(alphabet, k=20))
        assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_ranking_equals_brute_force(spark, corpus):
    assert ranking(spark, *corpus) == plain_ranking(*corpus)


def test_small_shards_and_bundles_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "BUNDLE", 7)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 50)
    docs, items = corpus
    expected = plain_ranking(docs, items, 3)
    assert ranking(spark, docs, items, 3, partitions=1) == expected


def test_a_long_list_of_terms_is_joined(spark, corpus, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 20)
    docs, items = corpus
    assert ranking(spark, docs, items[-20:]) == plain_ranking(docs, items[-20:])


def test_stages_let_hopeless_documents_go():
    """An item that has reached a score carries only what can still reach it."""
    import pyarrow as pa

    schema = lexical_search.arrow_schema
    # The schema itself needs a session, so the row is checked through the scores.
    left = pa.table(
        {
            "bundle": pa.array([0], pa.int32()),
            "shard": pa.array([0], pa.int64()),
            "ids": [[1, 2, 3]],
            "sizes": [np.array([5, 5, 5], "<u4").tobytes()],
            "slots": [np.array([0, 0], "<u2").tobytes()],
            "places": [np.array([0, 2], "<u2").tobytes()],
            "scores": [np.array([100, 7], "<i8").tobytes()],
            "bounds": [[{"slot": 0, "later": 10, "reached": 90}]],
        }
    )
    right = pa.table(
        {
            "at": [np.array([1], "<u2").tobytes()],
            "counts": [np.array([1], "<u4").tobytes()],
            "weight": [1],
            "members": [[{"slot": 0, "q": 2}]],
        }
    )
    scores, _ = lexical_search.add_stage(left, right, 3, 15)
    assert scores.tolist() == [[100, 2 * (1_000_000_000 // (1000 + 800)), 7]]
    assert schema is not None


@pytest.mark.parametrize("docs, items", [([], [(1, "w")]), ([(1, "w")], []), ([(1, None)], [(1, "w")]), ([(1, "w")], [(1, "")])])
def test_empty_tables(spark, docs, items):
    assert ranking(spark, docs, items) == []


def test_one_document(spark):
    """The weight of a term that all documents hold is 0 in a small table."""
    docs, items = [(9, "only one"), (8, "two")], [(1, "one"), (2, "two one")]
    assert ranking(spark, docs, items) == plain_ranking(docs, items)
