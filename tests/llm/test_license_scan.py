import random
from itertools import combinations

from corpusquery.llm.license_scan import TEMPLATES, Scanner, longest_increasing, patience_align, scan_licenses


def test_longest_increasing_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randrange(8) for _ in range(rng.randrange(8))]
        chosen = [values[i] for i in longest_increasing(values)]
        assert all(a < b for a, b in zip(chosen, chosen[1:]))
        longest = max((n for n in range(len(values) + 1) for c in combinations(values, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(chosen) == longest


def test_alignment_is_common_and_rising():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(15))]
        b = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(15))]
        pairs = patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(patience_align(list("abcdef"), list("abXdef"))) == 5


def names(spark, *texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS n_words", "1 AS license")
    out = scan_licenses(docs, **more)
    assert out.columns == ["doc_id", "license", "n_words", "licenses"]
    return {r.doc_id: r.licenses for r in out.collect()}


def test_whole_changed_and_repeated_notices(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    mit = TEMPLATES["MIT"].split()
    cut = " ".join(w for i, w in enumerate(mit) if i % 9)  # one word in nine is gone
    half = " ".join(mit[: len(mit) // 2])
    notice = TEMPLATES["Apache-2.0 notice"]
    texts = [
        f"{filler(50)} {TEMPLATES['MIT']} {filler(50)}",
        f"{filler(50)}\n{cut}\n{filler(50)}",
        half,
        f"{notice} {filler(3)} {notice} {filler(400)} {notice.upper()}",
        None,
        "",
        f"{filler(100_000)} {TEMPLATES['GPL-3.0 notice']} {filler(100_000)}",
        "the the the License license under the License " * 200,
    ]
    got = names(spark, *texts)
    assert (got[0][0].license, got[0][0].coverage, got[0][0].first_word) == ("MIT", 1.0, 50)
    assert got[0][0].end_word - got[0][0].first_word == got[0][0].template_words
    assert got[1][0].license == "MIT" and 0.85 < got[1][0].coverage < 0.95
    assert got[2] == [] and got[4] == [] and got[5] == [] and got[7] == []
    assert (got[3][0].license, got[3][0].coverage, got[3][0].first_word) == ("Apache-2.0 notice", 1.0, 0)
    assert (got[6][0].license, got[6][0].coverage, got[6][0].first_word) == ("GPL-3.0 notice", 1.0, 100_000)


def test_neighbouring_notices(spark):
    mit, by, nc = (TEMPLATES[n] for n in ("MIT notice", "CC-BY-4.0 notice", "CC-BY-NC-4.0 notice"))
    got = names(spark, f"{mit} {mit}", f"{mit} {mit} {mit} and more words here", f"{by} {nc}", f"{nc} {by}", by, nc)
    found = {i: {x.license: x.coverage for x in v} for i, v in got.items()}
    assert found[0] == found[1] == {"MIT notice": 1.0}
    assert found[2] == found[3] == {"CC-BY-4.0 notice": 1.0, "CC-BY-NC-4.0 notice": 1.0}
    assert found[4] == {"CC-BY-4.0 notice": 1.0} and found[5] == {"CC-BY-NC-4.0 notice": 1.0}


def test_copies_are_found_wherever_they_stand():
    """Whole copies, next to each other, cut apart or among words of their own."""
    rng = random.Random(8)
    for _ in range(200):
        template = [b"t%d" % rng.randrange(9) for _ in range(rng.randrange(5, 12))]
        words = [b"x%d" % rng.randrange(99) for _ in range(rng.randrange(20))]
        copies = rng.randrange(4)
        for _ in range(copies):
            words += [*template, *(rng.choice([b"x1", *template]) for _ in range(rng.choice([0, 0, 1, 9])))]
        found = Scanner({"t": b" ".join(template).decode()}, 0.8).scan(words)
        assert [f["matched"] for f in found] == [len(template)] * bool(copies) or not copies
        for f in found:
            assert f["matched"] >= 0.8 * len(template) and f["end_word"] <= len(words)


def test_ties_own_templates_and_empty_tables(spark):
    got = names(spark, "one two three four", templates={"b": "one two", "a": "three four", "long": "two three four", "none": ""})
    assert [x.license for x in got[0]] == ["long", "a", "b"]
    assert names(spark) == {}
