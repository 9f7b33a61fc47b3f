"""All stages of the pipeline over documents whose fate is known."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers as public
import pytest
import tiktoken

from corpusquery.llm.byte_bpe import read_ranks
from corpusquery.llm.queries import MULTI_RANKS


def prose(rng, sentences, words=11):
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    return " ".join(" ".join(word() for _ in range(words)).capitalize() + "." for _ in range(sentences))


def rest_of(item):
    """The first sentence of an item inside one of its own."""
    return "Before it " + item.split(". ")[0].lower() + " and after it."


@pytest.fixture(scope="module")
def fates():
    """Texts by id, the texts that should be left, and the benchmark."""
    rng = random.Random(21)
    texts, left = {}, {}

    def keep(i, text, cleaned=None):
        texts[i] = text
        left[i] = text if cleaned is None else cleaned

    for i in range(12):
        keep(i, prose(rng, 20))
    nav, body = "Home | News | Sport | Contact", prose(rng, 18)
    keep(20, f"{nav}\n{body}\nAccept all cookies.", body)
    shared, a, b = prose(rng, 1, 14), prose(rng, 15), prose(rng, 15)
    keep(30, f"{a}\n{shared}")
    keep(31, f"{shared}\n{b}", b)
    passage, c, d = prose(rng, 6), prose(rng, 14), prose(rng, 14)
    keep(40, f"{c} {passage}")
    keep(41, f"{d} {passage}", d)
    original = prose(rng, 40)
    keep(50, original)
    words = original.split(" ")
    # Every sentence differs in a word, so no line goes, but the documents are one.
    near = " ".join(w if i % 110 else "other" for i, w in enumerate(words))
    texts[51], texts[52] = near, original
    texts[60], texts[61], texts[62], texts[63] = "too short to stay.", None, "", "word word " * 200
    item = prose(rng, 2, 13)
    texts[70] = f"{item} {prose(rng, 2)}"
    rest = prose(rng, 60)
    keep(71, f"{item.split('. ')[0]}. {rest}", rest)  # document 70 has that sentence first
    keep(72, f"{rest_of(item)} {prose(rng, 60)}")  # a hit, but far below a twentieth of the words
    keep(90, "Überall " + prose(rng, 12) + " Fin d'été. 日本語の文です。")
    return texts, left, [(1, item), (2, prose(rng, 3)), (3, None)]


def digests(text):
    ranks = read_ranks(public.path(MULTI_RANKS))
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = own.encode_ordinary(text)
    joined = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def write(spark, folder, texts, items):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "x") for i, t in texts.items()]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_document_meets_its_fate(spark, tmp_path, fates):
    texts, left, items = fates
    write(spark, tmp_path, texts, items)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert sorted(got) == sorted(left)
    assert got == {i: digests(t) for i, t in left.items()}


def test_stages_keep_the_columns(spark, tmp_path, fates):
    texts, _, items = fates
    write(spark, tmp_path, texts, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes


def test_empty_documents(spark, tmp_path):
    write(spark, tmp_path, {}, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
