"""Exact top-k search against all pairs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rigscope.llm import hamming, queries

SCHEMA = "distance string, vec_id long, embedding array<float>, rank string"


def plain(rows, asks, k, bits):
    points = {(i, tuple(v is not None and v > 0 for v in (e + [None] * bits)[:bits])) for i, e in rows
              if i is not None and e is not None}
    out = set()
    for i, code in points:
        if asks(i):
            others = {}
            for j, other in points:
                if j != i:
                    d = sum(a != b for a, b in zip(code, other))
                    others[j] = min(d, others.get(j, d))
            for rank, (d, j) in enumerate(sorted((d, j) for j, d in others.items())[:k], 1):
                out.add((i, rank, j, d))
    return out


@pytest.mark.parametrize("bits", [64, 20, 80])
def test_matches_all_pairs(spark, bits):
    rng = random.Random(bits)
    base = [[rng.uniform(-1, 1) for _ in range(bits)] for _ in range(25)]
    rows = []
    for i in range(300):
        e = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            e[rng.randrange(bits)] *= -1
        rows.append((i, e))
    rows += [(1000 + i, list(base[0])) for i in range(60)] + [(2000, [0.0] * bits), (2050, [1.0] * bits)]
    rows += [(None, base[0]), (3000, None), (3050, []), (3051, [None] * bits), (7, rows[7][1]), (50, base[3])]
    df = spark.createDataFrame([("clash", i, e, "clash") for i, e in rows], SCHEMA)
    got = [tuple(r) for r in hamming.nearest(df, F.col("vec_id") % 50 == 0, 5, bits).collect()]
    assert len(got) == len(set(got)) or sum(r[0] == 50 for r in got) == 10
    assert set(got) == plain(rows, lambda i: i % 50 == 0, 5, bits)


def test_fewer_rows_than_wanted(spark):
    df = spark.createDataFrame([("c", 0, [1.0, -1.0], "c"), ("c", 1, [1.0, 1.0], "c"), ("c", 2, [-1.0, 1.0], "c")], SCHEMA)
    got = sorted(tuple(r) for r in hamming.nearest(df, F.col("vec_id") == 0, 10, 64).collect())
    assert got == [(0, 1, 1, 1), (0, 2, 2, 2)]
    assert hamming.nearest(df, F.lit(False), 10, 64).collect() == []
    assert hamming.nearest(df.limit(0), F.lit(True), 10, 64).collect() == []
    assert hamming.nearest(df.where("vec_id = 0"), F.lit(True), 10, 64).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = sorted(con.sql(hamming.op2_sql()).fetchall())
    assert sorted(map(tuple, queries.op2_exact_top_k(spark, "/root/testdata/sf0.001").collect())) == want
