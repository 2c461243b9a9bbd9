"""Token counts against the tokenizer itself on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rigscope.llm import tokencounts
from rigscope.llm.tables import read

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "n_tokens string, doc_id long, text string, n_bytes string"


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]


def test_random_white_space_and_special_strings():
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", " \n", " ", "\x1c", "\x85", "'s", "'", "9", "!", "é", "日", "<|endoftext|>",
             "　", ".", " the", "\r", "<|", "|>", "é", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(20_000)]
    lengths = tokencounts._Lengths(PATH)
    assert tokencounts.count_tokens(texts, {" the": 1}, lengths) == library(texts)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokencounts, "_CACHED", 5)
    texts = ["some words and more words " * 20, "other text entirely", "x" * 500 + " " + "y" * 100]
    assert tokencounts.count_tokens(texts, {}, tokencounts._Lengths(PATH)) == library(texts)


def test_rows(spark):
    texts = [None, "", " ", "Hello  world\n\n", "<|endoftext|>", "word " * 2000, "ein Wort", "日本語 ☃"]
    docs = spark.createDataFrame([("clash", i, t, "clash") for i, t in enumerate(texts)] + [("c", 6, texts[6], "c"),
                                                                                          ("c", None, "id-less", "c")], SCHEMA)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.count(docs, PATH).collect()), key=str)
    rows = [*enumerate(texts), (6, texts[6]), (None, "id-less")]
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library([t for _, t in rows]))]
    assert got == sorted(want, key=str)
    assert tokencounts.count(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.collect()
    got = {r.doc_id: r.n_tokens for r in tokencounts.count(docs, PATH).collect()}
    assert got == dict(zip((r.doc_id for r in rows), library([r.text for r in rows])))


def test_summary_keeps_the_frequent_ones():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [" ".join(["often"] * 5 + [f"rare{i}{k}" for k in range(20)])
                                                 for i in range(200)]})
    out = pa.Table.from_batches(list(tokencounts._summaries(PATH, 8)([batch]))).to_pylist()
    assert len(out) <= 8 and " often" in {r["piece"] for r in out}


def test_the_table_comes_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "SAMPLED", 2, raising=False)
    docs = spark.createDataFrame([(f" word{i}" * 3,) for i in range(40)], "text string").coalesce(1)
    assert {f" word{i}" for i in range(40)} <= tokencounts.frequent_pretokens(docs, "text", PATH).keys()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokencounts._Lengths(public_tokenizers.path("word_bpe_49k.json"))
