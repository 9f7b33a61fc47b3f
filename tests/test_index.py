"""N-gram candidates, batch search, index maintenance and the stored index."""

import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusquery import regex, term
from corpusquery.operators import blocks, index, many_texts, narrowing, rollup
from corpusquery.operators.search import matching_files
from corpusquery.plans import joins
from corpusquery.sources import sinks
from workload.queries import REGISTRY

ALPHABET = "abé \nX😀"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(120)]


@pytest.fixture(scope="module")
def corpus(spark, texts):
    rows = [("hot" if i % 3 == 0 else f"r{i % 5}", f"f{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "repo string, path string, content string").cache()


@pytest.fixture(scope="module")
def asked(texts):
    rng = random.Random(3)
    out = [t[i : i + rng.randint(1, 6)] for t in texts if len(t) > 8 for i in (2,)]
    # Texts with whole words, of every length, and the odd ones.
    words = [t[:20] for t in texts[:40]] + [t[1:] for t in texts[40:60]]
    return out + words + ["", "absent", "a", "\n", "😀", " ", "  ", " a ", "a  b"]


def brute(texts, asked):
    return sorted(
        (q, f"f{i}") for q, text in enumerate(asked) for i, t in enumerate(texts) if text and text in t
    )


def as_queries(spark, asked):
    return spark.createDataFrame(list(enumerate(asked)), "query_id bigint, text string")


@pytest.fixture(scope="module")
def gram_index(corpus):
    return blocks.build_gram_index(corpus)


def pairs(df):
    return sorted((r.query_id, r.path) for r in df.collect())


@pytest.mark.parametrize("way", ["one block", "many blocks", "long list"])
def test_search_batch_against_brute_force(spark, corpus, texts, asked, monkeypatch, way):
    if way == "many blocks":
        monkeypatch.setattr(index, "AUTOMATON_BYTES", 300)
    if way == "long list":
        monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    assert pairs(index.search_batch(corpus, as_queries(spark, asked))) == brute(texts, asked)


def test_batch_search_reads_the_contents_once(spark, tmp_path, asked):
    """Long texts that share their starts and ends, repeated queries, one scan of the files."""
    head, tail = "the same beginning of all of them ", " and the same end for every text"
    bodies = [head + "x" * k + tail for k in range(40)]
    rows = [("r", str(k), f"before {t} after" if k % 2 else t[:-1]) for k, t in enumerate(bodies)]
    spark.createDataFrame(rows, "repo string, path string, content string").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    found = index.search_batch(files, as_queries(spark, [*bodies, *bodies]))
    expected = sorted((q + d, str(k)) for d in (0, 40) for q, t in enumerate(bodies) for k, r in enumerate(rows) if t in r[2])
    assert pairs(found) == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_decoding_shuffles_blocks_and_no_postings(spark, corpus, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    built = blocks.build_gram_index(corpus)
    gone = blocks.GramIndex(built.files.where("path != 'f5'"), built.blocks)
    found = blocks.decoded(gone)
    shown = lambda df: sorted(tuple(r) for r in df.select("gram", "path").collect())
    assert shown(found) == shown(index.ngram_postings(corpus.where("path != 'f5'")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # What is shuffled lies below the decoding.
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Repartition")


def test_counted_batch_search_joins_counts_instead_of_pairs(spark, corpus, texts, asked):
    """A text that very many queries ask is counted once, before the queries join."""
    many = [*asked, *["a"] * 500]
    found = index.search_batch(corpus, as_queries(spark, many), counted=True)
    expected = [(q, n) for q, t in enumerate(many) if t and (n := sum(t in content for content in texts))]
    assert sorted((r.query_id, r.n_files) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The tree is printed from the top, so the join stands before the aggregate that feeds it.
    assert plan.index("Join") < plan.index("Aggregate") < plan.index("MapInArrow")


def test_anchored_query_finds_first_sentences_and_whole_turns(spark, tmp_path):
    docs = ["One two. Three", "so One two again", "... dots", "nothing"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "One two. Else"), (1, 1, "user", "... dots"), (2, 0, "user", ""), (2, 1, "user", None)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    found = REGISTRY["search_batch_anchored"](spark, str(tmp_path))
    assert pairs(found) == [(1000, "en/0.txt"), (1000, "en/1.txt"), (1001, "en/2.txt")]


def test_text_table_against_brute_force():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    contents = [word(rng.randint(0, 200)) for _ in range(60)] + [""]
    cuts = [c[a : a + n] for c in contents for a, n in [(rng.randint(0, 150), rng.randint(1, 60))]]
    texts = sorted({t for t in [*cuts, *(t[:-1] + "x" for t in cuts), *(word(n) for n in range(1, 30))] if t})
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    class Table:
        select = lambda self, *names: self
        mapInArrow = lambda self, work, ddl: setattr(self, "work", work) or self
        toArrow = lambda self: pa.Table.from_batches(self.work(iter([rows])))

    table = pickle.loads(pickle.dumps(many_texts.TextTable(Table())))
    found = []
    for first, piece in many_texts.pieces(contents):
        for of, begin, size in table.places(piece):
            found += [(first + i, piece[i][a : a + n]) for i, a, n in zip(of, begin, size)]
    assert sorted(found) == sorted((i, t) for i, c in enumerate(contents) for t in texts if t in c)


def test_candidates_hold_every_match(spark, corpus, texts, asked, gram_index):
    found = set(pairs(index.candidates(gram_index, as_queries(spark, asked))))
    assert set(brute(texts, asked)) <= found
    grams = lambda s: {s.lower()[i : i + 3] for i in range(len(s) - 2)}
    expected = {
        (q, f"f{i}")
        for q, text in enumerate(asked)
        for i, t in enumerate(texts)
        if (grams(text) <= grams(t) if grams(text) else text and text.lower() in t.lower())
    }
    assert found == expected


@pytest.mark.parametrize("runs", ["small", "large"])
def test_blocks_decode_to_the_postings(spark, corpus, monkeypatch, runs):
    if runs == "small":
        monkeypatch.setattr(blocks, "RUN_FILES", 7)
        monkeypatch.setattr(blocks, "RUN_POSTINGS", 100)
    rows = lambda df: sorted(map(tuple, df.select("gram", "repo", "path").collect()))
    for n in (1, 2, 3):
        built = blocks.build_gram_index(corpus, n)
        assert rows(blocks.decoded(built)) == rows(index.ngram_postings(corpus, n))
        assert built.blocks.where("first > last OR n > last - first + 1").count() == 0
    with pytest.raises(ValueError):
        blocks.build_gram_index(corpus, 4)


def test_small_runs_find_the_same(spark, corpus, asked, gram_index, monkeypatch):
    whole = pairs(index.candidates(gram_index, as_queries(spark, asked)))
    monkeypatch.setattr(blocks, "RUN_FILES", 5)
    monkeypatch.setattr(blocks, "FIRST_GRAMS", 1)
    assert pairs(index.candidates(blocks.build_gram_index(corpus), as_queries(spark, asked))) == whole


@given(st.lists(st.lists(st.integers(0, (1 << 16) - 1), min_size=1, max_size=50, unique=True), max_size=8))
def test_numbers_as_bytes(lists):
    packed = []
    for numbers in lists:
        numbers.sort()
        data, _ = blocks.pack_numbers(np.diff(np.array(numbers)))
        packed.append((len(numbers), numbers[0], data.tobytes()))
    values, ends = blocks.decode(packed)
    assert values.tolist() == [x for numbers in lists for x in numbers]
    assert ends.tolist() == np.cumsum([len(x) for x in lists]).tolist()


def test_blocks_are_small_and_skipped_by_their_bounds(spark, tmp_path):
    """Stored bytes against rows of names, and blocks that bounds rule out."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(300)]
    rows = [("some/repository", f"dir/file{i}.txt", " ".join(rng.choices(words, k=60))) for i in range(1500)]
    files = spark.createDataFrame(rows, "repo string, path string, content string").coalesce(1)
    built = blocks.build_gram_index(files)
    built.blocks.orderBy("gram", "run").coalesce(1).write.option("compression", "zstd").parquet(f"{tmp_path}/blocks")
    index.ngram_postings(files).orderBy("gram", "repo", "path").coalesce(1).write.parquet(f"{tmp_path}/rows")
    size = lambda at: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    assert size(tmp_path / "blocks") * 2 < size(tmp_path / "rows")
    asked = spark.createDataFrame([(1, rows[700][2])], "query_id int, text string")
    found = index.candidates(built, asked)
    assert ("some/repository", rows[700][1]) in {(r.repo, r.path) for r in found.collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "first#" in plan and "<= high#" in plan and ">= low#" in plan


@pytest.mark.parametrize(
    "predicate",
    [
        term("aba"),
        term("éab") | term("abX"),
        term("aba") & (term("bab") | term("ab ")),
        term("aba") & ~term("X"),
        term("ab") & regex("b.a"),
        ~term("aba"),
    ],
    ids=str,
)
def test_narrowed_search_finds_the_same_files(corpus, gram_index, predicate):
    narrowed = index.narrow_files(corpus, gram_index, predicate)
    paths = lambda df: sorted(r.path for r in matching_files(df, predicate).collect())
    assert paths(narrowed) == paths(corpus)


def test_search_cost(corpus, gram_index):
    predicate = term("aba")
    cost = index.search_cost(corpus, gram_index, predicate, limit=2).first()
    n = matching_files(corpus, predicate).count()
    assert cost.file_count == n and cost.files_skipped == max(n - 2, 0)
    assert cost.files_considered >= n and cost.ngram_matches >= cost.files_considered
    everything = index.search_cost(corpus, gram_index, regex("a"), limit=None).first()
    assert everything.files_considered == corpus.count() and everything.ngram_matches == 0


def test_postings_are_distinct_without_a_shuffle(corpus):
    postings = index.ngram_postings(corpus)
    assert postings.count() == postings.distinct().count()
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()


def test_stored_index(spark, corpus, tmp_path):
    stored = corpus.withColumns({"source": F.col("repo"), "shard": F.lit(0)})
    sinks.write_index(stored, str(tmp_path), batch_id=0)
    sinks.write_index(stored, str(tmp_path), batch_id=0)  # a repeated batch
    as_set = lambda df: {tuple(r) for r in df.select("gram", "repo", "path").collect()}
    postings = sinks.read_postings(spark, str(tmp_path))
    assert as_set(postings) == as_set(index.ngram_postings(corpus))
    assert sinks.read_entries(spark, str(tmp_path)).count() == corpus.count()
    grams = narrowing.text_grams("éaba")
    pruned = sinks.read_postings(spark, str(tmp_path), grams)
    assert as_set(pruned) == {r for r in as_set(postings) if r[0] in grams}
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [gram_bucket" in plan.replace("isnotnull(gram_bucket#", "gram_bucket") or "gram_bucket" in plan
    candidates = lambda *grams: sorted(
        r.path
        for r in narrowing.predicate_candidates(sinks.read_gram_index(spark, str(tmp_path), *grams), term("éaba")).collect()
    )
    assert candidates(grams) == candidates()


def test_buckets_agree(spark):
    grams = ["abc", "éa\n", "😀xy"]
    df = spark.createDataFrame([(g,) for g in grams], "gram string")
    in_spark = [r.b for r in df.select(sinks.gram_bucket(F.col("gram")).alias("b")).collect()]
    assert in_spark == [sinks.gram_buckets_of([g])[0] for g in grams]


DIFF = "repo string, path string, content_sha string"


def test_index_diff(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], DIFF)
    new = spark.createDataFrame([("r", "b", "2"), ("r", "c", "4"), ("s", "a", "1")], DIFF)
    got = {(r.repo, r.path): r.status for r in index.index_diff(new, old).collect()}
    assert got == {("r", "a"): "deleted", ("r", "b"): "same", ("r", "c"): "changed", ("s", "a"): "new"}
    assert {r.status for r in index.index_diff(old, old).collect()} == {"same"}


def test_rolled_diff_reads_no_file_of_equal_repositories(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    old = [(f"r{i % 12}", f"d{i % 3}/f{i}" if i % 5 else f"f{i}", str(rng.random())) for i in range(600)]
    new = [(r, p, "changed" if r == "r3" and p.startswith("d0/") and int(p[4:]) % 2 else s) for r, p, s in old if not (r == "r5" and p == "f5")]
    new += [("r5", "d9/new", "x"), ("fresh", "a", "y")]
    old += [("gone", "a", "z"), ("r7", "same", "1"), ("r7", "same", "1")]
    new += [("r7", "same", "1"), ("r7", "same", "1")]
    sides = []
    for name, rows in (("new", new), ("old", old)):
        spark.createDataFrame(rows, DIFF).write.partitionBy("repo").parquet(f"{tmp_path}/{name}")
        sides.append(spark.read.parquet(f"{tmp_path}/{name}"))
    ups = [rollup.roll_up(s) for s in sides]
    key = lambda df: sorted(tuple(r) for r in df.select("repo", "path", "status", "new_sha", "old_sha").collect())
    found = rollup.index_diff_rolled(*sides, *ups)
    assert key(found) == key(index.index_diff(*sides).where("status <> 'same'")) and found.count() > 10
    folders = {tuple(r) for r in rollup.changed_folders(*ups).collect()}
    assert folders == {("r3", "d0"), ("r5", ""), ("r5", "d9"), ("fresh", ""), ("gone", "")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [repo") == 2 and "fresh" in plan and "r7" not in plan
    monkeypatch.setattr(rollup, "MAX_LISTED", 2)
    assert key(rollup.index_diff_rolled(*sides, *ups)) == key(found)
    assert rollup.index_diff_rolled(sides[0], sides[0], ups[0], ups[0]).count() == 0


ENTRIES = "shard int, repo string, path string, source string"


@pytest.mark.parametrize("limit", [None, 0])
def test_orphans(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", limit)
    entries = spark.createDataFrame(
        [(1, "a", "x", "src/a"), (1, "b", "x", "src/b"), (2, "a", "y", "src/a"), (3, "c", "x", "")], ENTRIES
    )
    live = spark.createDataFrame([("src/a",)], "source string")
    assert [(r.shard, r.repo) for r in index.orphan_entries(entries, live).collect()] == [(1, "b")]
    # A shard goes whole when any of its repositories is gone; no source is no orphan.
    assert [r.shard for r in index.orphan_shards(entries, live).collect()] == [1]
    assert sorted(r.shard for r in index.surviving_entries(entries, live).collect()) == [2, 3]


def test_prune_deleted(spark):
    mirrored = spark.createDataFrame(
        [("a", False), ("b", False), ("c", True)], "repo string, keep_deleted boolean"
    )
    upstream = spark.createDataFrame([("a",)], "repo string")
    assert [r.repo for r in index.prune_deleted(mirrored, upstream).collect()] == ["b"]
