"""ARC to WARC: parsing by version, equivalent records, round trips, revisits."""

import gzip
import hashlib
import io

import duckdb
import pytest

from rigscope.llm import archives, queries

SCHEMA = "record_type string, page_id long, url string, html string, key string"
OLD = (b"filedesc://old.arc 0.0.0.0 19970101120000 text/plain 73\n1 0 Some Crawler\n"
       b"URL IP-address Archive-date Content-type Archive-length\n\n"
       b"http://a.example/with blank 1.2.3.4 19970102 text/html 5\nhello\n"
       b"dns:a.example 1.2.3.4 199701021314 text/dns 4\n1 2\n\n")


def test_old_version_with_blanks_in_urls_and_short_dates():
    assert len(b"1 0 Some Crawler\nURL IP-address Archive-date Content-type Archive-length\n") == 73
    for content in (OLD, gzip.compress(OLD)):
        head, first, second = [e for _, e in archives.entries(content)]
        assert head.startswith(b"filedesc://old.arc\n1 0 Some Crawler")
        assert (first.url, first.date, first.payload, first.http) == ("http://a.example/with blank", "1997-01-02T00:00:00Z",
                                                                     b"hello", False)
        assert (second.url, second.date, second.payload) == ("dns:a.example", "1997-01-02T13:14:00Z", b"1 2\n")
        fields, block = next(archives.warc_records(io.BufferedReader(io.BytesIO(archives.warc_record(first, None)))))
        assert fields["warc-type"] == "resource" and block == b"hello" and fields["content-type"] == "text/html"


@pytest.mark.parametrize("version", [1, 2])
def test_written_records_are_read_by_their_version_block(version):
    data = archives.version_block("x.arc", version) + b"\n" + archives.arc_record("http://e/ x%", 7, b"a\n\nb", version, "x.arc")
    rows = list(archives.arc_records(io.BufferedReader(io.BytesIO(data + b"\n"))))
    assert len(rows) == 2 and len(rows[1][0]) == (5 if version == 1 else 10)
    entry = list(archives.entries(data))[1][1]
    assert (entry.key, entry.payload, entry.http, entry.url) == ("7", b"a\n\nb", True, "http://e/%20x%")


@pytest.mark.parametrize("bad", [b"http://x 0 0 0 1\na", b"filedesc://x 0.0.0.0 0 text/plain 9\n3 0 x\nURL\n", OLD[:-6]])
def test_broken_archives_are_refused(bad):
    with pytest.raises(ValueError):
        list(archives.entries(bad))


def test_dates():
    assert archives.warc_date("20240229235959") == "2024-02-29T23:59:59Z"
    assert archives.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert archives.warc_date("x") == archives.warc_date(None) == "1970-01-01T00:00:00Z"


PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9 ü%20", "same"), (3, None, None), (4, "", ""),
         (5, "http://a/5", "own\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://a/6", "x" * 300_000), (7, "http://a/7", "é日\n\n"),
         (7, "http://a/7", "é日\n\n"), (None, "http://a/n", "no id"), (None, "http://a/n2", "no id")]


@pytest.mark.parametrize("min_bytes, per_file", [(0, 8192), (4, 3)])
def test_round_trip(spark, scratch, min_bytes, per_file):
    pages = spark.createDataFrame([("clash", *p, "clash") for p in PAGES], SCHEMA).repartition(2)
    arc, warc = f"{scratch}/arc", f"{scratch}/warc"
    archives.write_arc(pages, arc, records_per_file=per_file)
    archives.convert(spark, arc, warc, min_bytes=min_bytes, records_per_file=per_file)
    rows = archives.read_warc(spark, warc).collect()
    assert all(r.sound for r in rows)
    rows = [r for r in rows if r.record_type != "warcinfo"]
    assert len(rows) == len(PAGES) and len({r.record_id for r in rows}) == len(rows)
    by_id = {r.record_id: r for r in rows}
    bodies = {}
    for r in rows:
        if r.record_type == "response":
            bodies[r.payload_digest] = bytes(r.payload)
        else:
            assert by_id[r.refers_to_id].record_type == "response"
            assert by_id[r.refers_to_id].payload_digest == r.payload_digest and by_id[r.refers_to_id].key == r.refers_to
    got = sorted(((r.key, r.url, bodies[r.payload_digest].decode(), r.payload_bytes) for r in rows), key=str)
    assert got == sorted(((k, u and u.replace(" ", "%20") or None, h or "", len((h or "").encode())) for k, u, h in PAGES),
                         key=str)
    kinds = {(r.key, r.record_type, r.refers_to) for r in rows}
    assert {(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (7, "revisit", 7), (7, "response", None)} <= kinds
    assert ((3, "revisit", 4) in kinds) == (min_bytes == 0) and (4, "response", None) in kinds
    assert sorted(r.record_type for r in rows if r.key is None) == ["response", "revisit"]


def test_empty_table(spark, scratch):
    archives.write_arc(spark.createDataFrame([], SCHEMA), f"{scratch}/arc")
    archives.convert(spark, f"{scratch}/arc", f"{scratch}/warc")
    assert archives.read_warc(spark, f"{scratch}/warc").collect() == []


def test_digest():
    assert archives.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest()[:4] == "da39"


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.001/pages.parquet')")
    want = sorted(con.sql(archives.op5_sql()).fetchall())
    assert sorted(map(tuple, queries.op5_warc(spark, "/root/testdata/sf0.001").collect())) == want
