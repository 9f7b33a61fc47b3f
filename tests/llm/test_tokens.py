import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import pytest

from corpusquery.llm import byte_bpe
from corpusquery.llm.queries import BYTE_BPE, END_ID, MULTI_RANKS, token_digests
from corpusquery.llm.token_index import Bucket, PerfectHash, write_token_store

TEXTS = [
    "Plain words, it's 42 of them.",
    None,
    "",
    " leading and  double  spaces \n\n and\ttabs ",
    "naïve Größe 日本語 😀👍🏽 ​　x",
    "----====aaaa    \x1c\x85 <|endoftext|>",
    "Plain words, it's 42 of them.",
    "ab" * 3000,
    "many words here. " * 20_000,
]


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    ranks = byte_bpe.read_ranks(public.path(MULTI_RANKS))
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary


def test_ids_offsets_and_the_way_back(spark, documents, tiktoken_ids):
    docs = documents(*TEXTS)
    path = public.path(MULTI_RANKS)
    tokens = byte_bpe.encode(docs, path, public.PATTERN, offsets=True, keep_text=True)
    for r in tokens.collect():
        text = r.text or ""
        assert r.ids == tiktoken_ids(text)
        assert len(r.starts) == len(r.ends) == len(r.ids)
        covered = {c for a, b in zip(r.starts, r.ends) for c in range(a, b)}
        assert covered == set(range(len(text)))
    back = byte_bpe.decode(tokens.drop("text"), path, public.PATTERN)
    assert [r.text for r in back.orderBy("doc_id").collect()] == [t or "" for t in TEXTS]


def test_offsets_agree_with_the_library(spark, documents):
    path = public.path(BYTE_BPE)
    text = TEXTS[4]
    row = byte_bpe.encode(documents(text), path, offsets=True).first()
    own = byte_bpe.load_tokenizer(path).encode(text, add_special_tokens=False)
    assert row.ids == own.ids
    assert list(zip(row.starts, row.ends)) == own.offsets


def test_split_characters_nulls_and_unknown_ids(spark):
    path = public.path(BYTE_BPE)
    table = byte_bpe.token_bytes(path)
    one = {b[0]: i for i, b in enumerate(table) if len(b) == 1}
    euro = [one[b] for b in "€".encode()]
    rows = [(1, [*euro, one[65]], "a"), (2, euro[:2], "b"), (3, None, "c"), (4, [], "d"), (5, [one[66], -1, 10**6, None], "e")]
    df = spark.createDataFrame(rows, "k long, ids array<int>, text string")
    got = {r.k: (r.bytes, r.text) for r in byte_bpe.decode(df, path).collect()}
    assert got[1] == ("€A".encode(), "€A")
    assert got[2] == ("€".encode()[:2], "�")
    assert got[3] == (None, None)
    assert got[4] == (b"", "") and got[5] == (b"B", "B")


def test_digests(spark, documents, tiktoken_ids):
    got = {r.doc_id: r for r in token_digests(documents(*TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        ids = tiktoken_ids(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert token_digests(documents("x").limit(0)).collect() == []


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 20_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        slots = PerfectHash.build(keys).slots(keys)
        assert sorted(slots.tolist()) == list(range(keys.size))
    runs = {"shard": np.zeros(keys.size, int)}
    bucket = Bucket.load(Bucket.build(keys, runs).dump())
    assert (bucket.find(keys) >= 0).all()
    others = rng.integers(2**62, 2**63 - 1, 50_000)
    assert (bucket.find(others) >= 0).sum() <= 2


def test_store_keeps_every_document_under_its_key(spark, documents):
    texts = [*TEXTS, *(f"text {i} of many" for i in range(300))]
    docs = documents(*texts)
    copies = docs.where("doc_id < 3").selectExpr("5L AS doc_id", "text", "lang", "source", "n_chars")
    nameless = docs.where("doc_id IN (4, 20)").selectExpr("NULL AS doc_id", "text", "lang", "source", "n_chars")
    everything = docs.unionByName(copies).unionByName(nameless).repartition(7)
    store = write_token_store(everything, public.path(BYTE_BPE), END_ID)
    got = store.read(store.lookup(everything)).collect()
    encode = byte_bpe.load_tokenizer(public.path(BYTE_BPE)).encode
    ids = lambda t: [*encode(t or "", add_special_tokens=False).ids, END_ID]
    expected = sorted((-1 if r.doc_id is None else r.doc_id, ids(r.text)) for r in everything.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert [x.tolist() for x in store.get(7)] == [ids(texts[7])]
    assert len(store.get(5)) == 4 and len(store.get(None)) == 2 and store.get(10**9) == []


def test_store_of_an_empty_table(spark, documents):
    docs = documents("x").limit(0)
    store = write_token_store(docs, public.path(BYTE_BPE), END_ID)
    assert store.read(store.lookup(docs)).collect() == []


@pytest.mark.parametrize("name, pattern", [(BYTE_BPE, None), (MULTI_RANKS, public.PATTERN)])
def test_new_words_go_to_the_merges(name, pattern):
    """Every new word took a call of the whole library, most of the time of op10 and op2."""
    path = public.path(name)
    words = [f"w{chr(97 + k % 26)}x{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" for k in range(3000)]
    odd = ["naïve", "Größe", "日本語", "it's", "'s", "12345", "--", "a\u00a0b", "\x1c", "e\u0301", "😀", "<|endoftext|>", "x\ty", "ﬁ", "z" * 60, "\u200d", "ªº", "ʰa", "Ωmega"]
    texts = [" ".join(words[k : k + 40]) + ("." if k % 3 else ",\nnext line") for k in range(0, 3000, 30)]
    texts += [f"a {x} b {x}, {x}\n{x} {x}.\n {x}" for x in odd] + ["  ".join(odd), " ".join(odd), "", " "]
    encoder = byte_bpe.Encoder(path, pattern)
    calls, plain = [], encoder.encode
    for chunks in (encoder.first, encoder.spaced, encoder.whole):
        chunks.encode = lambda x: (calls.append(x), plain(x))[1]
    got = [encoder.raw(t) for t in texts]
    assert len(calls) < 300
    tokenizer = byte_bpe.load_tokenizer(path, pattern)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_go_to_the_merges_only_where_they_are_one_piece():
    from tokenizers import AddedToken, Tokenizer, models, normalizers, pre_tokenizers

    def fresh(split, normalizer=None):
        tokenizer = Tokenizer(models.BPE(vocab={"a": 0}, merges=[]))
        tokenizer.pre_tokenizer = split
        if normalizer is not None:
            tokenizer.normalizer = normalizer
        return tokenizer

    level = pre_tokenizers.ByteLevel
    assert byte_bpe.keeps_words(fresh(level(add_prefix_space=False)), None)
    assert not byte_bpe.keeps_words(fresh(level(add_prefix_space=True)), None)
    assert not byte_bpe.keeps_words(fresh(level(add_prefix_space=False, use_regex=False)), None)
    assert not byte_bpe.keeps_words(fresh(level(add_prefix_space=False), normalizers.Lowercase()), None)
    added = fresh(level(add_prefix_space=False))
    added.add_tokens([AddedToken("word")])
    assert not byte_bpe.keeps_words(added, None)
    ranks = fresh(level(add_prefix_space=False, use_regex=False))
    assert byte_bpe.keeps_words(ranks, public.PATTERN)
    assert not byte_bpe.keeps_words(ranks, r" ?[A-Z]+| ?\p{L}+|\s+")
    assert not byte_bpe.keeps_words(ranks, r" ?\p{Ll}+|\s+")
