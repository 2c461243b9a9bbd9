"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import rigscope.llm.queries as queries
from rigscope.llm import runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and not any(
                    all(words[s + k] == words[s + k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_rest(words, found):
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def random_words(rng):
    n, letters, words = rng.randint(0, 80), rng.randint(1, 4), []
    pick = lambda: bytes([97 + rng.randrange(letters)])
    while len(words) < n:
        words += [pick() for _ in range(rng.randint(1, 9))] * rng.randint(2, 9) if rng.random() < 0.4 else [pick()]
    return words[:n]


def test_runs_equal_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 12))]
        for words, (own, kept) in zip(texts, runs.describe(texts)):
            expected = plain_runs(words)
            assert [tuple(r) for r in own[np.lexsort((own[:, 2], own[:, 0]))].tolist()] == expected
            assert kept == plain_rest(words, expected)


def test_words_of_other_texts_are_not_neighbours():
    half = [b"a", b"b"] * 2
    assert all(not len(own) for own, _ in runs.describe([half, half, half]))


@pytest.mark.parametrize("period", [1, 7, 4096, 60_000])
def test_very_long_runs(period):
    words = [b"w%d" % (i % period) for i in range(250_000)]
    (own, kept), = runs.describe([[b"x", *words, b"y"]])
    assert own.tolist() == [[1, 250_000, period]]
    assert kept == [b"x", *words[:period], b"y"]


def test_wavelet_queries_equal_sorting():
    rng = np.random.default_rng(3)
    values = rng.permutation(500)
    tree = runs.WaveletMatrix(values, 9)
    lo = rng.integers(0, 499, 300)
    hi = rng.integers(lo + 1, 501)
    bound, rank = rng.integers(0, 500, 300), rng.integers(0, hi - lo)
    assert tree.below(lo, hi, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, bound)]
    assert tree.smallest(lo, hi, rank).tolist() == [int(np.sort(values[a:b])[r]) for a, b, r in zip(lo, hi, rank)]


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(top[:3] if top else (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(plain_rest(words, found))))


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n ", "one", "a a a a a a", "a b c\u0085d " * 9, "é x " * 12]
    texts += [" ".join(w.decode() + rng.choice(["", "", "\t", "\n"]) for w in random_words(rng)) for _ in range(250)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(9, texts[9], "again")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{folder}/documents.parquet")
    got = queries.op11_periodic_runs(spark, folder)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted((plain_digest(k, t) for k, t, _ in rows), key=str)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _, _ in rows)


def test_empty_table_and_null_id(spark):
    schema = "doc_id long, text string, start string, r int"
    assert runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    row, = runs.periodic_runs(spark.createDataFrame([(None, "b c " * 5, "s", 1)], schema)).collect()
    assert (row.doc_id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (None, 10, [(0, 10, 2)], "b c")
