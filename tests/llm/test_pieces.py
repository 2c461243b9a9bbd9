"""Sampled segmentations: lossless, reproducible, and drawn with the lattice's probabilities."""

import math
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rigscope.llm import pieces
from rigscope.llm.tables import read

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "piece_ids string, doc_id long, text string, decoded string"


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(pieces.Vocabulary(PATH))


def draw(sampler, texts, seeds):
    out, counts = pieces.sample_texts(sampler, texts, np.array(seeds, np.uint64))
    return [x.tolist() for x in np.split(out, np.cumsum(counts)[:-1])]


def every_segmentation(v, text):
    """(pieces, probability) by walking all paths."""
    logs = {v.bytes[i].decode(): (int(i), lp) for i, lp in zip(v.ids, v.log)}
    found = []

    def walk(rest, path, total):
        if not rest:
            found.append((tuple(path), math.exp(total)))
        for n in range(1, len(rest) + 1):
            if rest[:n] in logs:
                walk(rest[n:], path + [logs[rest[:n]][0]], total + logs[rest[:n]][1])

    walk(" " + text, [], 0.0)
    whole = sum(p for _, p in found)
    return {path: p / whole for path, p in found}


@pytest.mark.parametrize("text", ["the", "ofthe", "inder"])
def test_draws_follow_the_lattice(sampler, text):
    want, n = every_segmentation(sampler.vocabulary, text), 40_000
    got = Counter(map(tuple, draw(sampler, [text] * n, range(n))))
    assert set(got) <= set(want)
    assert sum(abs(got[p] / n - want[p]) for p in want) < 0.03
    assert len(got) > 1


TEXTS = [None, "", " ", "\n", "▁", " ▁\n▁x ▁▁", "a  b\t c\r\n\nd ", "日本語 ☃ 😀 \x00", "x" * 5000,
         "word " * 3000, "The end.\nNew line", "ﬁ ½ é é"]


def test_lossless_and_independent_of_batches(sampler):
    table = sampler.vocabulary.bytes
    whole = draw(sampler, TEXTS, range(len(TEXTS)))
    assert [pieces.join_pieces(table, x) for x in whole] == [t or "" for t in TEXTS]
    fresh = pieces.Sampler(sampler.vocabulary, kept_units=3)
    before, pieces._CHUNK_UNITS = pieces._CHUNK_UNITS, 7
    try:
        assert [draw(fresh, [t], [k])[0] for k, t in enumerate(TEXTS)] == whole
    finally:
        pieces._CHUNK_UNITS = before


def test_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(10, TEXTS[10]), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([("clash", d, t, "clash") for d, t in rows], SCHEMA)
    got = pieces.segmentations(docs, PATH).collect()
    assert len(got) == len(rows)
    assert all(r.decoded == r.text and (r.piece_ids is None) == (r.text is None) for r in got)
    assert len({tuple(r.piece_ids) for r in got if r.doc_id == 10}) == 1
    assert pieces.segmentations(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    again = pieces.segmentations(docs.repartition(3), PATH).collect()
    assert Counter((r.doc_id, str(r.piece_ids)) for r in got) == Counter((r.doc_id, str(r.piece_ids)) for r in again)


def test_documents_are_lossless(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    assert all(r.text == r.decoded for r in pieces.segmentations(docs, PATH).collect())


def test_long_units_are_drawn_as_short_ones(sampler, monkeypatch):
    """The plain walk gives the draws of the arrays, in any batch."""
    texts = ["thequickbrownfox" * 60, "日本語のテキスト" * 90, "a" * 700 + " short " + "☃x" * 400, "word " * 200]
    own = draw(pieces.Sampler(sampler.vocabulary), texts, range(4))
    monkeypatch.setattr(pieces, "_LONG_UNIT", 10**9)
    assert draw(pieces.Sampler(sampler.vocabulary), texts, range(4)) == own
    monkeypatch.setattr(pieces, "_LONG_UNIT", 3)
    assert draw(pieces.Sampler(sampler.vocabulary), texts, range(4)) == own


@pytest.mark.parametrize("text", ["thequickbrownfox" * 20_000, "日本語" * 30_000])
def test_hundreds_of_thousands_of_characters_without_a_blank(sampler, text):
    fresh = pieces.Sampler(sampler.vocabulary)
    began = time.process_time()
    out, = draw(fresh, [text], [5])
    assert time.process_time() - began < 30                   # places were once filtered at 0.1 ms each
    assert pieces.join_pieces(sampler.vocabulary.bytes, out) == text
