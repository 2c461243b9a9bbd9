"""Alignments against both tokenizers on whole texts, cut end by end."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rigscope.llm import alignment
from rigscope.llm.tables import read

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a  b", "a \n b", "a\n\n b  \n", "x ▁ y", "<s> </s> <unk> <|endoftext|>", "é ﬁ ①", "日本語 テキスト 漢字",
       "😀😀 a😀", "a" * 500, "\x00 \x1c \x85 a", "\t\t a\tb ", "don't I'll we've 12345 ,.;!!", "a　b   c", " lead", "trail "]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


def plain(text, aligner):
    """(tokens of A, of B, groups, groups as text, times that each id pair is linked), None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    bytes_a, bytes_b = [aligner.bytes_a[k] for k in a], [aligner.bytes_b[k] for k in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))), np.cumsum(list(map(len, bytes_b)))
    groups, links, low = [], Counter(), 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        left, right = ([x for x, e in zip(ids, ends) if low < e <= end] for ids, ends in ((a, ends_a), (b, ends_b)))
        groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
        links.update((x, y) for x in left for y in right)
        low = end
    return len(a), len(b), len(groups), ";".join(groups), links


def random_texts(n):
    rng = random.Random(4)
    parts = ["a", "b", " ", " ", "\n", "\t", "é", "the", "ing", "x", ".", "'s", "1", "日", " \n ", "\x85", " "]
    return ["".join(rng.choice([*parts, "▁"] if rng.random() < 0.1 else parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("wide", [0, 4096])
def test_units_add_up_to_whole_texts(spark, aligner, monkeypatch, wide):
    monkeypatch.setattr(alignment, "_WIDE", wide)
    own = alignment.Aligner(*PATHS)
    texts = ODD + random_texts(300) + [
        r.text for r in read(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 3000").limit(40).collect()]
    for part in (texts, texts[::-1]):                                    # the second time from the cache
        totals, groups, many, pairs, times = alignment.align_texts(part, own)
        ends = np.concatenate([[0], np.cumsum(many)])
        for k, text in enumerate(part):
            found = {(p // own.size_b, p % own.size_b): n
                     for p, n in zip(pairs[ends[k]:ends[k + 1]].tolist(), times[ends[k]:ends[k + 1]].tolist())}
            expected = plain(text, aligner)
            if expected is None:
                assert not totals[k].any() and groups[k] == "" and not found, text
            else:
                assert tuple(totals[k].tolist()) == (*expected[:3], expected[4].total()), text
                assert (groups[k], found) == (expected[3], dict(expected[4]))


def test_cache_keeps_results(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "_KEPT", 3)
    own = alignment.Aligner(*PATHS)
    for text in random_texts(60):
        totals, groups, *_ = alignment.align_texts([text], own)
        expected = plain(text, aligner)
        assert groups[0] == (expected[3] if expected else "")


def test_no_units_and_none_without_loss(aligner):
    own = alignment.Aligner(*PATHS)
    assert own.align([]) == {} and own.align([" \u2581"]) == {" \u2581": None}
    totals, groups, *_ = alignment.align_texts([None, ""], own)
    assert not totals.any() and groups == ["", ""]


def test_counts_over_the_corpus(spark, aligner):
    texts = ODD + random_texts(60) + ["the thing in a line", "the thing in a line", "the the the"]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(3, texts[3], "clash", 2), (None, "the line", "clash", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row int")
    found = [plain(t, aligner) for _, t, _, _ in rows]
    held = Counter(p for x in found if x for p in x[4])
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    expected = []
    for (k, *_), x in zip(rows, found):
        links = x[4] if x else Counter()
        expected.append((k, *(x[:3] if x else (0, 0, 0)), links.total(), sum(n for p, n in links.items() if held[p] == top[p[0]]),
                         sum(n * held[p] for p, n in links.items()), hashlib.sha256(x[3].encode()).hexdigest() if x else ""))
    got = alignment.align(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert alignment.align(docs.limit(0), *PATHS).count() == 0


def test_long_texts_without_blanks(aligner):
    (total, *_), groups, *_ = alignment.align_texts(["日本" * 100_000], aligner)
    assert total[0] and groups[0].count(";") == total[2] - 1


class Spy:
    """Tokenizer A, keeping the texts that it was given."""

    def __init__(self, a):
        self.a, self.given = a, []

    def encode_batch_fast(self, texts, **more):
        self.given += texts
        return self.a.encode_batch_fast(texts, **more)


def test_units_are_read_as_few_texts_without_marks_between(aligner, monkeypatch):
    own = alignment.Aligner(*PATHS)
    own.a = Spy(own.a)
    units = alignment.units_of("some words.\nMore of\tthem,\n\nin a line é日")
    assert set(own.align(units)) == set(units) and own.a.given == ["".join(units)]
    monkeypatch.setattr(alignment, "_JOINED", 2)
    again = alignment.Aligner(*PATHS)
    assert again.align(units) == own.align(units) == {u: x for u in units for x in again.align([u]).values()}


def test_units_that_a_does_not_cover_have_no_alignment(aligner):
    own = alignment.Aligner(*PATHS)
    z = own.a.encode("z").ids[0]
    own.bytes_a[z], own.length_a[z] = b"", 0                              # as if A had no such byte
    totals, groups, *_ = alignment.align_texts(["one qz!two", "one two", "\tz"], own)
    assert not totals[[0, 2]].any() and groups[0] == groups[2] == ""
    assert groups[1] == plain("one two", aligner)[3]
    assert own.align([" \tz"]) == {" \tz": None}


def test_cache_holds_short_rows_only(aligner):
    own = alignment.Aligner(*PATHS)
    texts = ["some words " + "日本語" * 20, "some words ▁"]
    for _ in range(2):
        totals, groups, *_ = alignment.align_texts(texts, own)
        assert groups == [plain(texts[0], aligner)[3], ""] and not totals[1].any()
    assert set(own.young) == {" some", " words", " ▁"}
