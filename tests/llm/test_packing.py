import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusquery.llm import packing
from corpusquery.llm.packing import Shelf, Solution, WordEncoder, best_fit, cross, evolve, founders, pack
from corpusquery.llm.queries import WORD_BPE, op13_sequence_packing

TEXTS = [
    "Plain words, it's 42 of THEM.",
    None,
    "",
    " leading and  double  spaces \n\n and\ttabs\r\n ",
    "naïve Größe ΣΑΣ 日本語 😀👍🏽 ​　x é ́x",
    "----====aaaa    \x1c\x85 <|endoftext|> <|ENDOFTEXT|>",
    "İstanbul ǅ.",
    "ab" * 3000,
    "many words here. " * 3000,
]


@pytest.fixture(scope="module")
def library_ids():
    tokenizer = Tokenizer.from_file(public.path(WORD_BPE))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(library_ids):
    encode = WordEncoder(public.path(WORD_BPE))
    chance = random.Random(2)
    odd = "aA.,:'\"s tT\n\t*(_ªµºÀÿ×÷́  é ßΣσς1½日\x1c"
    texts = TEXTS + ["".join(chance.choices(odd, k=30)) for _ in range(3000)]
    ids, ends = encode(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == (library_ids(text) if text else []), text


def check_packing(rows, lengths, capacity):
    sequences = defaultdict(list)
    for uid, sequence, offset in rows:
        sequences[sequence].append((offset, lengths[uid]))
    assert sorted(r[0] for r in rows) == sorted(lengths)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80), st.integers())
def test_best_fit_takes_the_tightest_bin(lengths, seed):
    shelf, spaces, bins = Shelf(50), {}, np.zeros(len(lengths), np.int64)
    expected, n = [], 0
    for length in lengths:  # the same by looking at every bin
        fitting = [s for s in spaces.values() if s >= length]
        if fitting:
            k = next(k for k, s in spaces.items() if s == min(fitting))
        else:
            k, n = n, n + 1
            spaces[k] = 50
        spaces[k] -= length
        expected.append(spaces[k])
    assert best_fit(lengths, range(len(lengths)), bins, 0, shelf) == n
    left = [50] * n
    for i, length in enumerate(lengths):
        left[bins[i]] -= length
    assert sorted(left) == sorted(spaces.values())


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 30), min_size=2, max_size=60), st.integers(0, 1000))
def test_children_hold_every_piece_once_and_whole_bins_of_a_parent(lengths, seed):
    lengths, chance = np.array(lengths), random.Random(seed)
    population = founders(lengths, 30, chance)
    giver, taker = population[0], population[-1]
    child = cross(lengths, giver, taker, 30, chance)
    assert child.fill.max() <= 30 and child.fill.min() > 0 and child.fill.sum() == lengths.sum()

    def sets(solution):
        groups = defaultdict(set)
        for i, b in enumerate(solution.bins.tolist()):
            groups[b].add(i)
        return set(map(frozenset, groups.values()))

    # Bins of the giver may be filled up further, never broken.
    assert any(any(g <= c for c in sets(child)) for g in sets(giver))
    best = evolve(lengths, population, 30, chance)
    assert best[0].rank <= min(s.rank for s in population)


def test_evolution_beats_best_fit():
    """Pieces of which best fit, longest first, needs a bin too many."""
    chance, capacity, lengths = random.Random(4), 100, []
    for _ in range(60):  # bins that can be filled to the last place, cut in three
        a = chance.randint(20, 45)
        b = chance.randint(20, 45)
        lengths += [a, b, capacity - a - b]
    lengths = np.array(lengths)
    population = founders(lengths, capacity, chance)
    first = population[0].rank[0]
    for _ in range(60):
        population = evolve(lengths, population, capacity, chance)
    assert population[0].rank[0] < first


def test_rounds_share_what_decks_leave(spark, monkeypatch):
    monkeypatch.setattr(packing, "DECK", 64)
    chance = random.Random(7)
    lengths = {i: chance.choice([100, chance.randint(1, 99), chance.randint(1, 30)]) for i in range(1500)}
    lengths |= {i: 7 for i in range(1500, 2200)}  # very many of one length
    rows = spark.createDataFrame(list(lengths.items()), "uid long, length long")
    places = [tuple(r) for r in pack(rows, 100).select("uid", "sequence_id", "offset").collect()]
    n = check_packing(places, lengths, 100)
    assert n <= -(-sum(lengths.values()) // 100) + 2


def test_query_against_the_library(spark, tmp_path, library_ids):
    texts = TEXTS * 2
    rows = [(None if i == 4 else i % 12, t, "u", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, uid string, Length int").repartition(2).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = op13_sequence_packing(spark, str(tmp_path)).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = [*(library_ids(text) if text else []), 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    lengths = {k: r.length for k, r in enumerate(got)}
    n = check_packing([(k, r.sequence_id, r.offset) for k, r in enumerate(got)], lengths, 2048)
    assert n == -(-sum(lengths.values()) // 2048)


def test_sequences_hold_the_ids(spark, documents, library_ids):
    packing_ = packing.pack_documents(documents(*TEXTS), public.path(WORD_BPE), 0, 512)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing_.sequences().collect()}
    for r in packing_.pieces.join(packing_.places, "uid").collect():
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        ids = [*(library_ids(TEXTS[r.doc_id]) if TEXTS[r.doc_id] else []), 0]
        assert part.tolist() == ids[r.start : r.start + r.length]
    assert max(map(len, whole.values())) <= 512


def test_empty_table(spark, documents):
    empty = packing.pack_documents(documents(), public.path(WORD_BPE), 0, 2048)
    assert empty.places.count() == 0 and empty.sequences().count() == 0
