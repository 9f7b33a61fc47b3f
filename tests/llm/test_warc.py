import gzip
import io
from collections import defaultdict

from corpusquery.llm.queries import LLM_QUERIES
from corpusquery.llm.warc import assemble, payload_sha1, read_records, read_warc, write_warc

DDL = "page_id long, url string, html string, type string"


def captures(spark, rows, min_bytes=0):
    pages = spark.createDataFrame(rows, DDL).repartition(3)
    return assemble(read_warc(write_warc(pages, min_bytes))).collect()


def facts(row):
    of = lambda x: x and x.fields.get("pageid")
    return (of(row.metadata), row.capture.type, of(row.refers_to_metadata), row.capture.payload_bytes)


def test_captures_are_assembled_with_revisits(spark):
    long = "é<p>" * 100_000
    rows = [
        (1, "http://a.org/x?y", "same", ""),
        (2, "http://a.org/\r\nX: y", "same", ""),
        (3, None, "same", ""),
        (4, "http://b.org", None, ""),
        (5, "nonsense", "", ""),
        (6, "http://c.org/", long, ""),
        (7, "http://d.org/", "a\r\n\r\nWARC/1.1\r\n\r\nb", ""),
    ]
    got = captures(spark, rows)
    by_page = {r.metadata.fields["pageid"]: r for r in got}
    assert sorted(map(facts, got), key=str) == [
        ("1", "revisit", "3", 4),
        ("2", "revisit", "3", 4),
        ("3", "response", None, 4),
        ("4", "revisit", "5", 0),
        ("5", "response", None, 0),
        ("6", "response", None, len(long.encode())),
        ("7", "response", None, 18),
    ]
    assert by_page["1"].capture.payload is None
    assert bytes(by_page["6"].capture.payload).decode() == long
    assert bytes(by_page["7"].capture.payload).decode() == rows[6][2]
    assert by_page["1"].capture.payload_digest == payload_sha1(b"same")
    assert by_page["1"].request.head == "GET /x?y HTTP/1.1\r\nHost: a.org"
    assert by_page["2"].capture.target_uri == "http://a.org/%0D%0AX: y"
    assert by_page["3"].capture.target_uri is None
    assert all(r.capture.digest_ok for r in got if r.capture.type == "response")


def test_small_payloads_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc", ""), (4, "u", "abc", ""), (4, "u", "abc", ""), (None, "u", "abc", "")]
    assert sorted(map(facts, captures(spark, rows, min_bytes=3)), key=str) == [
        ("1", "response", None, 2),
        ("2", "response", None, 2),
        ("3", "revisit", "4", 3),
        ("4", "response", None, 3),
        ("4", "response", None, 3),
        (None, "revisit", "4", 3),
    ]
    assert captures(spark, []) == []


def test_reader_takes_plain_archives_and_one_stream():
    block = b"pageId: 1\r\n"
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    for data in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3):
        got = list(read_records(io.BytesIO(data)))
        assert [(h["warc-type"], b) for h, b in got] == [("metadata", block)] * 3


def test_query_agrees_with_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    same = defaultdict(list)
    for p in pages:
        same[p.html or ""].append(p.page_id)
    expected = set()
    for p in pages:
        last = max(same[p.html or ""])
        data = (p.html or "").encode()
        kind = ("response", None) if last == p.page_id else ("revisit", last)
        expected.add((p.page_id, len(data), payload_sha1(data), *kind))
    assert {tuple(r) for r in LLM_QUERIES["op3_warc_captures"](spark, sf).collect()} == expected
