"""Case folding, and what patterns demand of the texts they match."""

import random

import pytest
from pyspark.sql import functions as F

from corpusquery import regex, search, term
from corpusquery.functions.folding import fold, fold_char, fold_text, folds_alike_everywhere
from corpusquery.operators.blocks import build_gram_index
from corpusquery.operators.narrowing import narrow_files, predicate_candidates
from corpusquery.operators.search import matching_files
from corpusquery.plans.gram_query import Demand, pattern_demand


def holds(demand, text):
    if demand is None:
        return True
    if demand.kind == "text":
        return demand.text in text
    return (all if demand.kind == "all" else any)(holds(p, text) for p in demand.parts)


def shown(demand):
    if demand is None or demand.kind == "text":
        return demand and demand.text
    return {demand.kind: sorted((shown(p) for p in demand.parts), key=str)}


@pytest.mark.parametrize(
    "pattern, demand",
    [
        ("foo.*bar", {"all": ["bar", "foo"]}),
        ("(foo|bar)baz", {"any": ["barbaz", "foobaz"]}),
        ("colou?r", {"any": ["color", "colour"]}),
        ("ab[cd]e", {"any": ["abce", "abde"]}),
        ("x{3}y", "xxxy"),
        ("(abc){2,}d", {"all": ["abcabc", "abcd"]}),
        ("(abc)+", "abc"),
        ("(abc)*def", "def"),
        ("Name$", "name"),
        (r"\Qa.b\Ec", "a.bc"),
        (r"a\.b\d+cde", {"all": ["a.b", "cde"]}),
        (r"\bword\b", "word"),
        ("(?i)(?:one|two)(?=three)", {"any": ["one", "two"]}),
        ("abc|", None),
        ("ab|abcd", None),
        ("a.c", None),
        ("[^a]bcd", "bcd"),
        ("[]a]bcd", {"any": ["]bcd", "abcd"]}),
        ("ſtraße", "straße"),
        ("(?x) a b c d # note", None),
        ("[abc&&[a]]bcd", None),
        (r"\x{41}bcd", None),
        ("abc(def", None),
    ],
)
def test_demands(pattern, demand):
    assert shown(pattern_demand(pattern, 3)) == demand


def random_pattern(chance, depth=0):
    kind = chance.random()
    if depth > 3 or kind < 0.4:
        atoms = ["a", "b", "c", "ab", "bca", "A", "é", "ſ", "S", "K", ".", "[ab]", "[a-c]", "[^a]", r"\w", r"\.", "İ", "ς", r"\n", "^", "$", r"\b"]
        return chance.choice(atoms)
    if kind < 0.6:
        return "".join(random_pattern(chance, depth + 1) for _ in range(chance.randint(2, 4)))
    inner = random_pattern(chance, depth + 1)
    if kind < 0.75:
        return f"(?:{inner}|{random_pattern(chance, depth + 1)})"
    if kind < 0.95:
        return f"(?:{inner}){chance.choice(['*', '+', '?', '{2}', '{1,3}', '{0,2}', '{5,}', '+?', '?+', '{3}'])}"
    return chance.choice([f"(?={inner})", f"(?>{inner})", f"(?<name{depth}x{chance.randint(0, 10**6)}>{inner})", f"(?!{inner})"])


def test_no_match_is_lost(spark):
    """Whatever the matcher finds fulfils the demand: random patterns over random texts."""
    chance = random.Random(8)
    patterns = [random_pattern(chance) + random_pattern(chance) + random_pattern(chance) for _ in range(400)]
    texts = ["".join(chance.choices("aabbccABCéÉsſSkK.İiıσςΣ\n _", k=chance.randint(0, 25))) for _ in range(300)]
    files = spark.createDataFrame([(t,) for t in texts], "content string")
    narrowed = found = 0
    for begin in range(0, len(patterns), 100):
        part = patterns[begin : begin + 100]
        rows = files.select("content", fold(F.col("content")).alias("folded"), F.array(*[regex(p).column() for p in part]).alias("hits"))
        demands = [pattern_demand(p, 3) for p in part]
        for row in rows.collect():
            for pattern, demand, hit in zip(part, demands, row.hits):
                found += hit
                narrowed += demand is not None and not holds(demand, row.folded)
                assert not hit or holds(demand, row.folded), (pattern, row.content, demand)
    assert found > 1000 and narrowed > 1000


def test_folding_agrees_with_the_matcher(spark):
    """All characters that the matcher takes for each other fold alike."""
    pairs = set()
    for c in map(chr, range(0x20000)):
        if "\ud800" <= c <= "\udfff":
            continue
        for d in (c.upper(), c.lower(), c.title(), fold_char(c)):
            pairs |= {(c, x) for x in (d, fold_char(d[0]), d[0].lower(), d[0].upper()) if len(x) == 1 and x != c}
    rows = spark.createDataFrame(sorted(pairs), "c string, d string")
    same = F.rlike(F.col("c"), F.concat(F.lit("(?iu)^\\Q"), F.col("d"), F.lit("\\E$")))
    seen = rows.select("c", "d", same.alias("same"), fold(F.col("c")).alias("x"), fold(F.col("d")).alias("y")).collect()
    assert sum(r.same for r in seen) > 2500
    lost = [(r.c, r.d, r.x, r.y) for r in seen if r.same and r.x != r.y]
    assert lost == []
    # Literals of predicates are folded in Python.
    other = [r.c for r in seen if folds_alike_everywhere(r.c) and fold_text(r.c) != r.x]
    assert other == []


def test_long_s_is_found_through_the_index(spark):
    rows = [("r", "a", "The License"), ("r", "b", "the licenſe"), ("r", "c", "liſt"), ("r", "d", "K and K")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    built = build_gram_index(files)
    for predicate, expected in ((regex("license"), ["a", "b"]), (term("license"), ["a", "b"]), (regex("k and k"), ["d"])):
        scanned = sorted(r.path for r in matching_files(files, predicate).collect())
        narrowed = narrow_files(files, built, predicate)
        assert scanned == expected == sorted(r.path for r in matching_files(narrowed, predicate).collect())


def test_alternatives_load_fewer_files(spark):
    rows = [("r", str(i), f"text {i} {'apache license' if i % 10 == 0 else 'mit licence' if i % 10 == 1 else 'none'}") for i in range(100)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    built, predicate = build_gram_index(files), regex("(apache|mit) licen[sc]e")
    assert predicate_candidates(built, predicate).count() == 20
    for mode in ("lines", "files", "repos"):
        plain = search(files, predicate, mode=mode, limit=7)
        assert sorted(map(tuple, search(files, predicate, index=built, mode=mode, limit=7).collect())) == sorted(map(tuple, plain.collect()))


def test_demand_as_a_condition(spark):
    demand = Demand("all", (Demand("text", text="a"), Demand("any", (Demand("text", text="b"), Demand("text", text="c")))))
    rows = spark.createDataFrame([("ab",), ("ac",), ("a",), ("bc",)], "t string")
    kept = rows.where(demand.column(lambda t: F.contains("t", F.lit(t)))).collect()
    assert [r.t for r in kept] == ["ab", "ac"]
    assert sorted(demand.literals()) == ["a", "b", "c"]
