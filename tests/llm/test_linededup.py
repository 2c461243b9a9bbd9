"""Line deduplication against a plain version with exact site counts."""

import duckdb

import rigscope.llm.queries as queries
from rigscope.llm import linededup

SCHEMA = "gone string, doc_id long, text string, source string, key string, n int"


def plain(rows, min_sites, min_chars):
    sites, places = {}, {}
    for doc, text, source in rows:
        for pos, raw in enumerate(text.split("\n") if text is not None else []):
            line = raw.strip(" ").lower()
            if len(line) >= min_chars and line.strip():
                sites.setdefault(line, set()).add(source)
                places.setdefault(line, []).append((doc is not None, doc or 0, pos))
    out = []
    for doc, text, source in rows:
        if text is None:
            out.append((doc, None))
            continue
        kept = []
        for pos, raw in enumerate(text.split("\n")):
            line = raw.strip(" ").lower()
            if line not in sites:
                kept.append(raw)
                continue
            spread = len(sites.get(line, set()) - {None})
            if spread < min_sites or (doc is not None, doc or 0, pos) == min(places[line]):
                kept.append(raw)
        out.append((doc, "\n".join(kept)))
    return out


def test_edge_rows_match_plain_version(spark):
    rows = [(i, f"own line number {i:09d}\n  Shared boilerplate LINE \nshort\n", f"s{i % 9}") for i in range(40)]
    rows += [(100 + i, "only on four sites, this\nshared boilerplate line", f"t{i % 4}") for i in range(8)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "\n\n", None), (203, "a null site holds this line", None),
             (204, "nothing shared here at all", "s2"), (None, "shared boilerplate line\nof a row without id", "s3"),
             (205, "exactly five sites hold this", "s0"), (206, "exactly five sites hold this", "s1"),
             (207, "exactly five sites hold this", "s2"), (208, "exactly five sites hold this", "s3"),
             (209, "exactly five sites hold this\n" * 50, "s4"), (210, "exactly five sites hold this", None),
             (204, "nothing shared here at all", "s2")]
    rows += [(300 + i, f"ok\nown {i}\n\t\n \u00a0\nOK", f"s{i}") for i in range(5)]           # a short line on five sites
    docs = spark.createDataFrame([("clash", d, t, s, "clash", 1) for d, t, s in rows], SCHEMA)
    got = linededup.dedup_lines(docs, removed_col="removed")
    assert got.columns == [*docs.columns, "removed"]
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert found == sorted(plain(rows, 5, 1), key=str)
    assert {r.removed for r in got.where("doc_id = 209").collect()} == {50}
    assert {r.text for r in got.where("doc_id = 304").collect()} == {"own 4\n\t\n \u00a0"}
    longer = linededup.dedup_lines(docs, min_chars=16)
    assert sorted(((r.doc_id, r.text) for r in longer.collect()), key=str) == sorted(plain(rows, 5, 16), key=str)


def test_spread_near_threshold_is_exact(spark):
    rows = [(f"line {n}", f"site{k}") for n in range(1, 60) for k in range(n)]
    lines = spark.createDataFrame([(s, 1, 2, 3, hash(x) % 10**9) for x, s in rows],
                                  "site string, doc long, code long, pos int, line long")
    found, _ = linededup.boilerplate(lines, min_sites=30, lg_k=4, near=0.9)   # coarse sketches: exact counts must settle
    assert found.count() == 30
    assert {r.sites for r in found.where("exact").collect()} == set(range(30, 60)) & {
        r.sites for r in found.where("exact").collect()}


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.sql(queries.SQL["op9_line_dedup"]).fetchall())
    assert sorted(map(tuple, queries.op9_line_dedup(spark, "/root/testdata/sf0.001").collect())) == want
