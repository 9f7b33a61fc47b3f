import hashlib
import random
import re

from corpusquery.llm import decontaminate
from corpusquery.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        of_item = words(item)
        n = min(13, len(of_item))
        for window in {tuple(of_item[k : k + n]) for k in range(len(of_item) - n + 1)} if n and name is not None else ():
            for at in range(len(own) - n + 1):
                if tuple(own[at : at + n]) == window:
                    hit.update(range(at, at + n))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(own)


def check(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS n_hit", "1 AS item_id")
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected(texts[r.doc_id], items)
        assert r.item_id == 1


def make(rng, n):
    return " ".join(rng.choice(["a", "b", "C", "é", "d4", "e!"]) for _ in range(n))


def cases():
    rng = random.Random(2)
    items = [(k, make(rng, n)) for k, n in enumerate([40, 13, 12, 14, 30, 5, 4, 3])]
    items += [(3, make(rng, 20)), (50, None), (51, ""), (52, "..."), (None, make(rng, 3)), (60, items[0][1])]
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [None, "", "?!", "a", make(rng, 3)]
    texts += [make(rng, rng.randrange(60)) for _ in range(40)]
    for k in (0, 1, 3):
        text = items[k][1]
        texts += [text, text.upper(), f"{plain(100)} {text}. {plain(100)}", f"{plain(400)} {text}", f"{text} {text}"]
    texts += [" ".join(items[0][1].split()[:12]), " ".join(items[0][1].split()[1:]), items[0][1]]
    return texts, items


def test_hits_agree_with_plain_python(spark):
    check(spark, *cases())


def test_items_in_many_blocks_and_empty_tables(spark, monkeypatch):
    texts, items = cases()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    check(spark, texts, items)
    check(spark, texts[:4], [])
    check(spark, [], items)


def test_long_document_and_clean_neighbours_stay(spark, documents):
    rng = random.Random(4)
    item = " ".join(f"q{rng.randrange(1000)}" for _ in range(40))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    docs = documents(long, f"{long} {item}", f"{item} and few others", "clean", None)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]
