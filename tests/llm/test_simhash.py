"""SimHash near-duplicates against a plain all-pairs version."""

import random
import re

import pytest
import xxhash

from rigscope.llm import simhash
from rigscope.llm.components import connected_components
from rigscope.llm.tables import read

SCHEMA = "text string, doc_id long, fingerprint string, component_id string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, text) → [(doc_id, hex, component)] by brute force over all pairs."""
    codes = [plain_fingerprint(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                of[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f"{codes[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=str)


def test_documents_match_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert order(got) == order(plain_components(rows))


def test_edge_rows(spark):
    rng = random.Random(5)
    base = [f"word{rng.randrange(400)}" for _ in range(4000)]
    texts = [None, "", " \n\t", "one", "One two", "one two three", "ONE two  three\nfour", "É Ö ß", "é Ö ß"]
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += ["same text again and again"] * 5
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same text again and again"), (None, "alone here now"), (3, "one")]
    docs = spark.createDataFrame([(t, d, "clash", "clash") for d, t in rows], SCHEMA)
    got = [tuple(r) for r in simhash.near_duplicates(docs, tile_rows=4).collect()]
    assert order(got) == order(plain_components(rows))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("tile_rows", [16, 300])
def test_close_links_join_the_same_codes_as_all_pairs(spark, tile_rows):
    rng = random.Random(1)
    codes = {rng.getrandbits(64) for _ in range(200)}
    for c in list(codes)[:60]:
        for _ in range(4):
            x = c
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.close_links(spark.createDataFrame([(c,) for c in signed], "code long"), 3, tile_rows)
    got = {r.node: r.root for r in connected_components(links).collect()}
    of = {c: c for c in signed}

    def find(c):
        while of[c] != c:
            c = of[c]
        return c

    for x in signed:
        for y in signed:
            if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3:
                p, q = sorted((find(x), find(y)))
                of[q] = p
    want = {c: find(c) for c in signed if any(find(c) == find(d) for d in signed if d != c)}
    assert {k: v for k, v in got.items()} == want


def test_components_of_a_long_chain_and_odd_links(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 7), (9, None), (601, 600), (600, 601)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 600, 601: 600}
