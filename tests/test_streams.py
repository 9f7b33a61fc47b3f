"""Task state, retention, sources and streaming jobs."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusquery import read_corpus, search_lines, shared_dir, term
from corpusquery.operators import lifecycle
from corpusquery.operators.blocks import decoded
from corpusquery.operators.lines import match_rows
from corpusquery.operators.symbols import detect_language
from corpusquery.sources import sinks
from corpusquery.sources.snapshots import Snapshots
from corpusquery.streaming import jobs
from workload.queries import REGISTRY


def test_retention_is_strict(spark):
    now = datetime(2024, 1, 4)
    rows = [(i, now - timedelta(hours=72) + timedelta(seconds=i)) for i in (-1, 0, 1)]
    df = spark.createDataFrame(rows, "i int, ts timestamp")
    assert [r.i for r in lifecycle.retain(df, "ts", now=now).orderBy("i").collect()] == [0, 1]
    assert lifecycle.retain(df, "ts").count() == 0


STATES = ("pending", "running", "completed", "failed")


@pytest.mark.parametrize("n,left", [(1000, 1000), (1001, 501)])
def test_eviction(spark, n, left):
    tasks = spark.range(n).select(
        F.col("id"), F.element_at(F.array(*map(F.lit, STATES)), (F.col("id") % 4 + 1).cast("int")).alias("status")
    )
    kept = lifecycle.evict_finished(tasks)
    assert kept.count() == left
    if left < n:
        assert {r.status for r in kept.select("status").distinct().collect()} == {"pending", "running"}


EVENTS = "id string, seq bigint, status string, error string, ts timestamp"


def events(n=300):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    out = []
    for seq in range(n):
        # One task receives a third of all events.
        task = "hot" if seq % 3 == 0 else f"t{rng.randint(0, 20)}"
        status = rng.choice(STATES)
        out.append((task, seq, status, "boom" if status == "failed" else None, start + timedelta(minutes=rng.randint(0, 50))))
    return out


def last_states(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r[4], r[1])):
        best[r[0]] = (r[2], r[3])
    return best


def test_latest_status(spark):
    rows = events()
    got = lifecycle.latest_status(spark.createDataFrame(rows, EVENTS))
    assert {r.id: (r.status, r.error) for r in got.collect()} == last_states(rows)


@pytest.mark.parametrize("changes", [16, 2])
def test_streaming_status_equals_batch(spark, tmp_path, monkeypatch, changes):
    monkeypatch.setattr(jobs, "MAX_CHANGES", changes)
    rows = events()
    feed = tmp_path / "in"
    for k in range(5):
        spark.createDataFrame(rows[k::5], EVENTS).coalesce(1).write.mode("append").parquet(str(feed))
    base = shared_dir(spark, "t")
    stream = jobs.read_feed(spark, str(feed), EVENTS, files_per_batch=1)
    jobs.stream_latest_status(stream, f"{base}/out", f"{base}/cp").awaitTermination()
    got = jobs.read_latest_status(spark, f"{base}/out")
    assert {r.id: (r.status, r.error) for r in got.collect()} == last_states(rows)
    # Changes are merged before they become many.
    assert len(Snapshots(spark, f"{base}/out").latest()["folders"]) <= min(changes, 5)
    # A batch that runs again after a failure leaves the same table.
    jobs._save_tasks(spark.createDataFrame(rows[4::5], EVENTS), 4, f"{base}/out", None, None)
    assert {r.id: (r.status, r.error) for r in jobs.read_latest_status(spark, f"{base}/out").collect()} == last_states(rows)


def test_idle_tasks_are_let_go(spark, monkeypatch):
    monkeypatch.setattr(jobs, "MAX_CHANGES", 0)
    base, start = shared_dir(spark, "t"), datetime(2024, 1, 1)
    rows = [("old", 0, "running", None, start), ("new", 1, "running", None, start + timedelta(hours=5))]
    jobs._save_tasks(spark.createDataFrame(rows, EVENTS), 0, f"{base}/out", None, timedelta(hours=2))
    assert [r.id for r in jobs.read_latest_status(spark, f"{base}/out").collect()] == ["new"]


def test_streaming_eviction_over_batches(spark, tmp_path):
    """Finished tasks go at an overflow; those that finish later stay until the next one."""
    rows, cap, feed = events(), 12, tmp_path / "in"
    start = datetime(2024, 1, 2)
    batches = [rows[:100], [("t3", 1000, "completed", None, start)], rows[100:], [(f"x{i}", 2000 + i, "pending", None, start) for i in range(20)]]
    base, table = shared_dir(spark, "t"), {}
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(feed))
        stream = jobs.read_feed(spark, str(feed), EVENTS, files_per_batch=1)
        jobs.stream_eviction(stream, f"{base}/out", f"{base}/cp", cap=cap).awaitTermination()
        for r in batch:
            if r[0] not in table or (r[4], r[1]) >= (table[r[0]][4], table[r[0]][1]):
                table[r[0]] = r
        if len(table) > cap:
            table = {k: r for k, r in table.items() if r[2] in ("pending", "running")}
        got = {r.id: (r.status, r.error, r.ts) for r in jobs.read_latest_status(spark, f"{base}/out").collect()}
        assert got == {k: r[2:] for k, r in table.items()}
    assert len(Snapshots(spark, f"{base}/out").latest()["folders"]) == 1


def test_snapshots_name_whole_versions(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.latest() is None
    for k in range(5):
        spark.range(k + 1).write.parquet(f"{tmp_path}/t/f{k}")
        table.publish(k, {"folders": [f"f{k}"]}, [f"f{k - 1}"] if k else [])
        assert table.latest()["folders"] == [f"f{k}"] and table.latest(k) == (table.read(k - 1) if k else None)
        # The folder of the version before is still there for its readers.
        assert k < 1 or table.exists(f"f{k - 1}")
        assert k < 2 or not table.exists(f"f{k - 2}")
    table.publish(4, {"folders": ["f4"]}, ["f3"])  # a repeated batch
    assert table.table(table.latest()["folders"], "id bigint").count() == 5
    assert table.table([], "id bigint").count() == 0


def test_retention_while_time_goes_on(spark, tmp_path):
    start, feed = datetime(2024, 1, 1), tmp_path / "in"
    base = shared_dir(spark, "t")
    now = lambda batch: start + timedelta(hours=30 * (batch + 1))
    rows = []
    for k in range(4):
        part = [(100 * k + i, start + timedelta(hours=30 * k + i)) for i in range(0, 30)] + [(-k, start)]
        rows += part
        spark.createDataFrame(part, "i int, ts timestamp").coalesce(1).write.mode("append").parquet(str(feed))
        stream = jobs.read_feed(spark, str(feed), "i int, ts timestamp", files_per_batch=1)
        jobs.stream_retention(
            stream, "ts", f"{base}/out", f"{base}/cp", timedelta(hours=50), now=now
        ).awaitTermination()
        expected = sorted(i for i, ts in rows if ts >= now(k) - timedelta(hours=50))
        kept = jobs.read_retained(spark, f"{base}/out")
        assert sorted(r.i for r in kept.collect()) == expected and kept.columns == ["i", "ts"]
    # Expired days are gone from the disk, not only from the result.
    folders = Snapshots(spark, f"{base}/out").latest()["folders"]
    assert min(folders.values()) == str((now(3) - timedelta(hours=50)).date())
    left = spark.read.option("recursiveFileLookup", True).schema("i int, ts timestamp").parquet(f"{base}/out/batch-0")
    assert left.count() == 0 or left.agg(F.max("ts")).first()[0] >= now(2) - timedelta(hours=50)


FILES = "repo string, path string, content string, source string, shard int"


def write_files(spark, path, rows):
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(str(path))


def test_streaming_search_equals_batch(spark, tmp_path):
    rows = [("r", f"f{i}", "a\nneedle x\nneedle" if i % 4 else "none", "s", 0) for i in range(20)]
    write_files(spark, tmp_path / "in", rows[:9])
    write_files(spark, tmp_path / "in", rows[9:])
    base = shared_dir(spark, "t")
    stream = jobs.read_feed(spark, str(tmp_path / "in"), FILES, files_per_batch=1)
    jobs.stream_search(stream, term("needle"), f"{base}/out", f"{base}/cp", context=1).awaitTermination()
    batch = match_rows(search_lines(spark.createDataFrame(rows, FILES), term("needle"), limit=None, context=1))
    as_rows = lambda df: sorted(map(str, df.select("repo", "path", "line_no", "line", "before", "after", "fragments").collect()))
    assert as_rows(spark.read.parquet(f"{base}/out")) == as_rows(batch)


def test_streaming_index(spark, tmp_path):
    first = [("r", "a", "alpha", "s", 0), ("r", "b", "beta", "s", 0)]
    second = [("r", "b", "gamma", "s", 1), ("r", "a", "alpha", "s", 1), ("q", "c", "delta", "s2", 1)]
    base = shared_dir(spark, "t")
    for rows in (first, second):
        write_files(spark, tmp_path / "in", rows)
        stream = jobs.read_feed(spark, str(tmp_path / "in"), FILES)
        jobs.stream_index(stream, f"{base}/index", f"{base}/cp").awaitTermination()
    raw = spark.read.parquet(f"{base}/index/entries")
    # The unchanged file is not indexed again.
    assert sorted((r.path, r.batch_id) for r in raw.collect()) == [("a", 0), ("b", 0), ("b", 1), ("c", 1)]
    entries = {r.path: r.shard for r in sinks.read_entries(spark, f"{base}/index").collect()}
    assert entries == {"a": 0, "b": 1, "c": 1}
    grams = {r.gram for r in sinks.read_postings(spark, f"{base}/index").where("path = 'b'").collect()}
    assert "gam" in grams and "bet" not in grams  # only those of the current version
    # A batch that runs again after a failure leaves the same index.
    batch = spark.createDataFrame(second, FILES)
    jobs.index_batch(batch, 1, f"{base}/index")
    assert sorted((r.path, r.batch_id) for r in spark.read.parquet(f"{base}/index/entries").collect()) == [
        ("a", 0), ("b", 0), ("b", 1), ("c", 1),
    ]


def test_index_with_repeated_and_deleted_files(spark):
    base = shared_dir(spark, "t")
    ddl = FILES + ", at int"
    batches = [
        [("r", "a", "alpha", "s", 0, 1), ("r", "b", "beta", "s", 0, 1), ("r", "c", "gone", "s", 0, 1)],
        [("r", "a", "early", "s", 0, 2), ("r", "a", "later", "s", 0, 3), ("r", "c", None, "s", 0, 2), ("r", "d", None, "s", 0, 2)],
    ]
    for k, rows in enumerate(batches):
        jobs.index_batch(spark.createDataFrame(rows, ddl), k, f"{base}/index", version="at")
    entries = {r.path: r.n_bytes for r in sinks.read_entries(spark, f"{base}/index").collect()}
    assert entries == {"a": 5, "b": 4}
    grams = lambda at: {(r.path, r.gram) for r in sinks.read_postings(spark, at).collect()}
    expected = {("a", g) for g in ("lat", "ate", "ter")} | {("b", g) for g in ("bet", "eta")}
    assert grams(f"{base}/index") == expected
    sinks.compact_index(spark, f"{base}/index", f"{base}/compact")
    assert grams(f"{base}/compact") == expected
    assert spark.read.parquet(f"{base}/compact/entries").count() == 2


def test_compaction_in_mid_stream(spark, tmp_path):
    """Versions stay whole while batches are merged; files come, change and go."""
    base, truth, feed = shared_dir(spark, "t"), {}, tmp_path / "in"
    pinned = None
    for k in range(6):
        rows = [("r", f"f{k}", f"alpha number {k}", "s", 0), ("r", "same", f"version {k} of it", "s", 0)]
        if k == 3:
            rows.append(("r", "f0", None, "s", 0))
        truth |= {r[1]: r[2] for r in rows}
        write_files(spark, feed, rows)
        stream = jobs.read_feed(spark, str(feed), FILES)
        jobs.stream_index(stream, f"{base}/index", f"{base}/cp", compact_every=3).awaitTermination()
        index = sinks.read_gram_index(spark, f"{base}/index")
        expected = {p: t for p, t in truth.items() if t is not None}
        assert {r.path: r.n_bytes for r in sinks.read_entries(spark, f"{base}/index").collect()} == {
            p: len(t) for p, t in expected.items()
        }
        got = {(r.gram, r.path) for r in decoded(index).collect()}
        assert got == {(t[i : i + 3], p) for p, t in expected.items() for i in range(len(t) - 2)}
        if pinned is not None:
            # A reader that started at the version before still sees it whole.
            assert {(r.gram, r.path) for r in decoded(pinned[0]).collect()} == pinned[1]
        pinned = (index, got)
    snapshot = sinks.index_versions(spark, f"{base}/index")
    assert len(snapshot["parts"]) < 3
    left = [p.name for p in Path(f"{base}/index/entries".removeprefix("file:")).iterdir() if p.name.startswith("batch_id")]
    assert len(left) <= 3
    # A batch that runs again after its version was merged changes nothing.
    jobs.index_batch(spark.createDataFrame(rows, FILES), 5, f"{base}/index")
    assert {(r.gram, r.path) for r in decoded(sinks.read_gram_index(spark, f"{base}/index")).collect()} == got


def test_a_batch_does_not_shuffle_contents(spark):
    base = shared_dir(spark, "t")
    files = spark.range(50).selectExpr("'r' AS repo", "string(id) AS path", "repeat(string(id), 50) AS content", "'s' AS source", "0 AS shard")
    seen = []
    original = sinks.build_gram_index
    sinks.build_gram_index = lambda df, *args: seen.append(df) or original(df, *args)
    try:
        jobs.index_batch(files, 0, f"{base}/index")
    finally:
        sinks.build_gram_index = original
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert sinks.read_entries(spark, f"{base}/index").count() == 50


def test_entry_files_do_not_multiply_with_tasks(spark):
    base = shared_dir(spark, "t")
    files = spark.range(3000).selectExpr(
        "concat('r', id % 300) AS repo", "string(id) AS path", "string(id) AS content", "'s' AS source", "1 AS shard"
    )
    counts = []
    for k, tasks in enumerate((2, 24)):
        sinks.write_entries(files.repartition(tasks), f"{base}/{k}")
        counts.append(spark.read.parquet(f"{base}/{k}/entries").select(F.input_file_name()).distinct().count())
    assert counts[0] == counts[1] <= sinks.ENTRY_BUCKETS


def test_streaming_retention_and_sweep(spark, tmp_path):
    now = datetime(2024, 1, 4)
    rows = [(i, now - timedelta(hours=i)) for i in (0, 71, 72, 73)]
    spark.createDataFrame(rows, "i int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    base = shared_dir(spark, "t")
    feed = jobs.read_feed(spark, str(tmp_path / "in"), "i int, ts timestamp")
    jobs.stream_retention(feed, "ts", f"{base}/out", f"{base}/cp", now=now).awaitTermination()
    assert sorted(r.i for r in jobs.read_retained(spark, f"{base}/out").collect()) == [0, 71, 72]

    files = spark.createDataFrame(
        [("r", "a", "x", "s1", 1), ("r", "b", "y", "s2", 1), ("r", "c", "z", "s1", 2)], FILES
    )
    sinks.write_index(files, f"{base}/index")
    spark.createDataFrame([("s1",)], "source string").write.parquet(str(tmp_path / "live"))
    # A listing that arrives in parts counts when its end has come.
    listing = "listing string, source string, last boolean"
    sweeps = lambda: {r.shard for r in spark.read.parquet(f"{base}/sweep").collect()}

    def arrive(*rows):
        spark.createDataFrame(rows, listing).coalesce(1).write.mode("append").parquet(str(tmp_path / "live"))
        live = jobs.read_feed(spark, str(tmp_path / "live"), listing, files_per_batch=1)
        jobs.stream_orphan_sweep(live, f"{base}/index", f"{base}/sweep", f"{base}/cp2").awaitTermination()

    arrive(("l1", "s2", False))
    assert sweeps() == set()
    arrive(("l1", "s1", False), ("l1", None, True))
    assert sweeps() == set()
    arrive(("l2", "s1", False), ("l2", None, True))
    assert sweeps() == {1}


def test_read_corpus_from_a_tree(spark, tmp_path):
    for name, data in {
        "host/o/r/src/a.py": b"x = 1\n",
        "host/o/r/b.txt": "é".encode() + b"\xff",
        "host/o/s/c.py": b"y",
        "host/o/s/empty.py": b"",
        "host/o/s/__init__.py": b"z",
        "host/o/s/.github/_config.yml": b"k: v",
        "host/o/r/host/o/r/again.txt": b"deep",
        "host/loose.txt": b"no repository",
    }.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    df = read_corpus(spark, str(tmp_path), fmt="tree")
    got = {(r.repo, r.path): r.content for r in df.collect()}
    assert got == {
        ("host/o/r", "src/a.py"): "x = 1\n",
        ("host/o/r", "b.txt"): "é�",
        ("host/o/s", "c.py"): "y",
        ("host/o/s", "empty.py"): "",
        ("host/o/s", "__init__.py"): "z",
        ("host/o/s", ".github/_config.yml"): "k: v",
        ("host/o/r", "host/o/r/again.txt"): "deep",
    }
    assert read_corpus(spark, f"file://{tmp_path}/", fmt="tree", glob="*.py").count() == 4
    assert df.first().branches == ["HEAD"]
    named = detect_language(df.where("path IN ('src/a.py', 'b.txt', 'c.py')"), {"py": "python"}, "text")
    assert {(r.path, r.language) for r in named.collect()} == {
        ("src/a.py", "python"), ("b.txt", "text"), ("c.py", "python"),
    }


def test_read_corpus_from_tables(spark, tmp_path):
    rows = [("r", "p", "text")]
    for fmt in ("parquet", "orc", "json"):
        spark.createDataFrame(rows, "repo string, path string, content string").write.format(fmt).save(str(tmp_path / fmt))
        row = read_corpus(spark, str(tmp_path / fmt), fmt).first()
        assert (row.repo, row.path, row.branches, row.language, row.content) == ("r", "p", ["HEAD"], "", "text")


def test_write_results(spark, tmp_path, text_file):
    found = search_lines(text_file("x\ny", "y"), term("x"), limit=None)
    sinks.write_lines_json(found, str(tmp_path / "json"))
    (row,) = spark.read.json(str(tmp_path / "json")).collect()
    assert row.file == "r:f0" and row.ranges["1"] == "x"
    sinks.write_results(found, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    with pytest.raises(Exception):
        sinks.write_results(found, str(tmp_path / "parquet"))


def test_shared_dir_is_fresh(spark):
    assert shared_dir(spark, "a") != shared_dir(spark, "a")


@pytest.mark.parametrize("parts", [0, 3])
def test_registered_streams_read_a_table_of_one_file_or_of_a_folder(spark, tmp_path, parts):
    rows = [(i, "MIT license\n" if i % 4 == 0 else "text", "en", f"src{i % 5}", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table = tmp_path / "sf" / "documents.parquet"
    if parts:
        docs.repartition(parts).write.parquet(str(table))
    else:
        docs.coalesce(1).write.parquet(str(tmp_path / "one"))
        table.parent.mkdir()
        next((tmp_path / "one").glob("part-*")).rename(table)
    of = lambda name: REGISTRY[name](spark, str(table.parent))
    found = {(r.repo, r.path) for r in of("stream_search").collect()}
    assert found == {(f"src{i % 5}", f"en/{i}.txt") for i in range(0, 40, 4)}
    assert of("stream_index").count() == 40
    # Only src3 is not listed, and its documents lie in two shards.
    assert {r.shard for r in of("stream_orphan_sweep").collect()} == {len("text"), len("MIT license\n")}
