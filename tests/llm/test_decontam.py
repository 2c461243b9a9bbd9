"""Decontamination against alignment of every document with every test item."""

import random

import numpy as np

from rigscope.llm import decontam
from rigscope.llm.tables import read

SCHEMA = "score string, doc_id long, text string, item_id string"


def plain_align(item, words):
    """Smith-Waterman cell by cell."""
    m, x, g = decontam.MATCH, decontam.MISMATCH, decontam.GAP
    row, best = [0] * (len(words) + 1), 0
    for a in item:
        left, nxt = 0, [0]
        for j, b in enumerate(words):
            left = max(0, row[j] + (m if a == b else x), row[j + 1] + g, left + g)
            nxt.append(left)
        row, best = nxt, max(best, max(nxt))
    return best / (m * len(item)) if item else 0.0


def test_align_matches_plain_alignment():
    rng = random.Random(2)
    for _ in range(200):
        item = [rng.randrange(1, 7) for _ in range(rng.randrange(1, 15))]
        words = [rng.randrange(0, 7) for _ in range(rng.randrange(0, 40))]
        score, first, last = decontam.align(np.array(item), np.array(words, np.int64))
        assert score == plain_align(item, words)
        if score:
            assert 0 <= first <= last < len(words)
            assert plain_align(item, words[first:last + 1]) == score


def test_documents_match_brute_force(spark):
    docs, items = (read(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, items).collect()}
    want = {}
    for d in docs.collect():
        words = decontam.words_of(d.text)
        numbers = {w: k for k, w in enumerate(sorted(set(words)))}
        have = np.array([numbers[w] for w in words], np.int64)
        for i in items.collect():
            item = [numbers.get(w, -1 - k) for k, w in enumerate(decontam.words_of(i.text))]
            score = decontam.align(np.array(item), have)[0]
            if score >= decontam.LEAST_SCORE:
                want[d.doc_id, i.item_id] = score
    assert got == want and got


def test_edited_copies_and_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    item = [word() for _ in range(40)]
    other = [word() for _ in range(30)]
    edited = list(item)
    for k in range(5, 40, 9):
        edited[k] = "changed"
    del edited[20]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, noise(50) + " " + " ".join(item) + " " + noise(50)), (2, " ".join(edited).upper()),
            (3, " ".join(item[:15]) + noise(200)), (4, None), (5, ""), (6, noise(300)), (7, " ".join(item[:39])),
            (8, (" ".join(item) + " ") * 300 + noise(5)), (9, " ".join(other) + " " + " ".join(item)),
            (None, " ".join(item)), (1, noise(10)), (10, " ".join(item)), (10, " ".join(item))]
    docs = spark.createDataFrame([("clash", d, t, "clash") for d, t in rows], SCHEMA)
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, ""), (5, "two words"),
                                   (None, noise(20)), (6, " ".join(item))], "item_id long, text string")
    for block_items in (100, 2):
        found = decontam.contaminated(docs, items, block_items=block_items).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted(
            [(d, i) for d in (1, 2, 7, 8, 9, 10, None) for i in (1, 6)] + [(9, 2)], key=str)
        assert {(r.start_word, r.end_word, r.score) for r in found if (r.doc_id, r.item_id) == (1, 1)} == {(50, 89, 1.0)}
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, 5, 6, None], key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    assert decontam.contaminated(docs, none).collect() == []
    assert decontam.contaminated(spark.createDataFrame([], SCHEMA), read(spark, "/root/testdata/sf0.001",
                                                                        "benchmark")).collect() == []


def test_random_edits_match_alignment_of_all_pairs(spark, monkeypatch):
    """Copies with any mix of replaced, dropped and added words, of short and long items, in prose of few words."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcd", k=3))
    items = {i: [word() for _ in range(n)] for i, n in enumerate((4, 5, 6, 9, 14, 14, 20, 20, 30, 59))}
    docs = {}
    for d in range(600):
        text = []
        for w in items[d % len(items)]:
            kind, rate = rng.random(), (d % 6) / 10
            if kind >= rate:
                text.append(w)
            elif kind < rate / 3:
                text.append(word())
            elif kind < rate * 2 / 3:
                text += [word(), w]
        docs[d] = [word() for _ in range(rng.randrange(9))] + text + [word() for _ in range(rng.randrange(9))]
    edited = [w if k not in (4, 10, 16) else "zzz" for k, w in enumerate(items[6])]
    docs[1000] = edited                                                      # words 5, 11 and 17 of 20 replaced
    docs[1001] = [w for pair in zip(items[7], ["zzz"] * 20) for w in pair][:31] + items[7][16:]
    docs[1002] = [word() for _ in range(9000)] + edited + [word() for _ in range(9000)]
    want = {}
    for d, have in docs.items():
        numbers = {w: k for k, w in enumerate(sorted(set(have)))}
        for i, item in items.items():
            score = decontam.align(np.array([numbers.get(w, -1 - k) for k, w in enumerate(item)]),
                                   np.array([numbers[w] for w in have], np.int64))[0]
            if score >= decontam.LEAST_SCORE:
                want[d, i] = score
    assert want[1000, 6] == 0.775 and (1001, 7) in want and (1002, 6) in want
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    for common in (64, 0):
        monkeypatch.setattr(decontam, "COMMON", common, raising=False)
        got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(rows, tests).collect()}
        assert got == want
