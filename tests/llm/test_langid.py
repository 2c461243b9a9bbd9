"""Language identification: held-out accuracy, undetermined texts, odd rows, whole texts."""

import random

import numpy as np
import pytest

from rigscope.llm import langid
from rigscope.llm.tables import read

SCHEMA = "lang_pred string, doc_id long, text string, lang string, score string"


def test_held_out_accuracy_on_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == truth.keys()
    held = [d for d in got if got[d].held_out]
    assert len(held) > 200
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.98
    assert np.mean([r.rejected for r in got.values()]) < 0.01
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rng = random.Random(3)
    make = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(30))
    rows = [(make(["ka", "to", "mi"]), "x") for _ in range(60)] + [(make(["sch", "eun", "rd"]), "y") for _ in range(60)]
    rows += [(None, "x"), ("", "y"), ("123 -- 45", "x"), ("katomi", None), (rows[0][0] * 3000, "x")]
    docs = spark.createDataFrame([("clash", i, t, lang, "clash") for i, (t, lang) in enumerate(rows)]
                                 + [("clash", None, "schschrd", "y", None), ("clash", 5, "eunrdeun", "y", None)], SCHEMA)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + 2
    by_id = {r.doc_id: r for r in got if r.doc_id != 5}
    for i in (120, 121, 122):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[123].lang_pred == "x" and by_id[124].lang_pred == "x" and by_id[None].lang_pred == "y"
    assert by_id[None].held_out
    assert langid.drop_rejected(docs).columns == docs.columns


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty).collect() == []
    unlabelled = spark.createDataFrame([("c", 1, "some words", None, None)], SCHEMA)
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_logits_of_long_texts_do_not_depend_on_strips():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(langid.BUCKETS + 1, 3)).astype(np.float32)
    scores[-1] = 0
    model = langid.LanguageModel(["a", "b", "c"], scores, np.zeros(3))
    texts = ["", "a", "ab cd", "word " * 500, "Ünïcode 日本語 text"] * 3
    whole = model.logits(texts)
    before, langid._STRIP = langid._STRIP, 64
    try:
        assert np.allclose(model.logits(texts), whole)
    finally:
        langid._STRIP = before
    text = "ab cd"
    chars = " ab cd "
    grams = {n: [chars[i:i + n] for i in range(len(chars) - n + 1)] for n in (2, 3, 4)}
    inside = [g for n in grams for g in grams[n] if g.strip() and " " not in g[1:-1]]
    assert sum((at != langid.BUCKETS).sum() for at in langid._subwords(langid._characters(text), 0, 99)) == len(inside)


def test_slices_tear_no_word():
    for text in ("", "a", "word " * 100, "x" * 300, " " * 50, "ab " * 30 + "y" * 90 + " cd", "é日 \n z " * 40):
        for limit in (1, 7, 40, 1000):
            parts = list(langid.slices(text, limit))
            assert "".join(parts) == text and all(p[:1] == " " for p in parts[1:])
            assert all(len(p) <= limit or " " not in p[1:limit] for p in parts)


def plain_score(model, text):
    """Softmax of the mean score of all subwords, one after the other."""
    chars = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    rows = []
    for n, factors in langid._MULTIPLIERS.items():
        for i in range(len(chars) - n + 1):
            gram = chars[i:i + n]
            if (any(gram) if n == 2 else all(gram[1:-1])):
                mixed = sum(c * f for c, f in zip(gram, factors)) & 0xFFFFFFFF
                mixed = (mixed ^ mixed >> 15) * 2246822507 & 0xFFFFFFFF
                rows.append(model.scores[mixed >> 16])
    logits = (np.sum(rows, axis=0, dtype=float) / max(1, len(rows)) + model.bias) / model.temperature
    share = np.exp(logits - logits.max())
    return share / share.sum()


def test_every_prediction_equals_plain_version(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs, ~langid.held_out_rows())
    found = docs.select("text", langid.predict(docs, model, docs["text"]).alias("p")).collect()
    assert len(found) > 100
    for text, (lang, score, rejected) in found:
        if text is None or not any(map(str.isalpha, text)):
            assert (lang, score, rejected) == (langid.UNDETERMINED, 0.0, True)
            continue
        if len(text) > 20_000:
            continue                                              # the plain walk is slow
        share = plain_score(model, text)
        assert score == pytest.approx(share.max(), abs=1e-6)
        if np.ptp(np.sort(share)[-2:]) > 1e-6:
            assert lang == model.labels[share.argmax()] and rejected == (score < model.least)


def test_descent_takes_the_steps_of_the_formula():
    """Two examples, one epoch: the fitted weights against gradients written out."""
    bags = [(0, np.array([3, 9]), np.array([0.5, 0.5], np.float32)), (1, np.array([9]), np.array([1.0], np.float32))]
    embedding, weight, bias, history = langid._sgd(bags, 2, 1, 0.5, 7)
    rng = np.random.default_rng(7)
    e = rng.uniform(-1 / langid.DIMENSION, 1 / langid.DIMENSION, (langid.BUCKETS, langid.DIMENSION)).astype(np.float32)
    w, b, losses = np.zeros((2, langid.DIMENSION)), np.zeros(2), []
    for step, k in enumerate(rng.permutation(2)):
        y, at, share = bags[k]
        mean = sum(s * e[a] for a, s in zip(at, share))
        p = np.exp(w @ mean + b)
        p /= p.sum()
        losses.append(-np.log(p[y]))
        error = (p - np.eye(2)[y]) * 0.5 * (1 - step / 2)
        back = error @ w
        w -= np.outer(error, mean)
        b -= 0.1 * error
        for a, s in zip(at, share):
            e[a] -= s * back
    np.testing.assert_allclose(weight, w, atol=1e-6)
    np.testing.assert_allclose(bias, b, atol=1e-6)
    np.testing.assert_allclose(embedding[[3, 9]], e[[3, 9]], atol=1e-6)
    assert history == [pytest.approx(np.mean(losses), abs=1e-6)]
