"""Quality rules against a plain version, and the sketch against sorting."""

import random
import re

import duckdb

from pyspark.sql import functions as F

import rigscope.llm.queries as queries
from rigscope.llm import quality


def plain_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS), len(lines),
            len(lines) - len(set(lines)), len(covered))


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "b", "é", "日本", "#", "$x", "word", "\n", "\t", "a b c", " ", "\x85"]
    return ["".join(rng.choice(parts[:rng.randint(3, 12)]) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(0, 90)))
            for _ in range(n)]


def test_measures_equal_plain_version(spark):
    texts = [None, "", " \n", "one", "a b c", "a b c a b c", "a a a a", "x\nx\n \nx", "a b"] + random_texts(200)
    rows = [(k, t, "en", "s", 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, w int")
    got = {r[0]: tuple(r[3:]) for r in quality.measure(docs).collect()}
    assert got == {k: plain_measure(t) for k, t, *_ in rows}


def test_buckets_hold_their_values(spark):
    values = spark.range(0, 70_000, 7).select(F.col("id").alias("v"), quality.bucket("id").alias("b"))
    low, high = quality.bucket_ends("b")
    bad = values.select("v", "b", low.alias("low"), high.alias("high")).where("v < low OR v > high OR (high - low + 1) * 32 > greatest(v, 32)")
    assert bad.count() == 0


def plain_bucket(v):
    if v < 64:
        return v, v
    step = 1 << v.bit_length() - 6
    return v // step * step, v // step * step + step - 1


def plain_judge(rows):
    seen = []
    for doc, text, lang, source in rows:
        n, chars, symbols, lines, again, repeat = m = plain_measure(text)
        base = n < quality.LEAST_WORDS or 100 * repeat > quality.MOST_REPEATED * n
        own = {"repeat": 1000 * repeat // max(n, 1), "symbol": 1000 * symbols // max(n, 1), "line": 1000 * again // max(lines, 1),
               "length": 100 * chars // max(n, 1)}
        seen.append((doc, lang, source, m, base, own))
    def limits(members, trait):
        values = sorted(x[5][trait] for x in members)
        q1, q3 = plain_bucket(values[(len(values) - 1) // 4])[0], plain_bucket(values[3 * (len(values) - 1) // 4])[1]
        least, both = quality.TRAITS[trait]
        spread = quality.FENCE * max(q3 - q1, least)
        return q1 - spread if both else float("-inf"), q3 + spread
    good, out = [x for x in seen if not x[4]], []
    for x in seen:
        kept = not x[4]
        if kept:
            for group in ([y for y in good if y[1:3] == x[1:3]], [y for y in good if y[1] == x[1]], good):
                if len(group) >= quality.LEAST_ROWS or group is good:
                    break
            for trait, value in x[5].items():
                low, high = limits(group, trait)
                kept &= low <= value <= high
        n, chars, symbols, _, again, repeat = x[3]
        out.append((x[0], n, chars, symbols, again, repeat, x[4], kept))
    return out


def corpus():
    rng = random.Random(11)
    rows = []
    for k in range(420):
        words = [rng.choice("alpha be gamma of delta the epsilon eta".split()) + str(rng.randrange(50)) for _ in range(rng.randint(40, 90))]
        if k % 17 == 0:
            words = [w + "###" for w in words]
        if k % 23 == 0:
            words = [w * 4 for w in words]
        if k % 29 == 0:
            words = words[:8] * 5 + words
        text = "".join(w + rng.choice("   \n") for w in words)
        if k % 31 == 0:
            text += "\none line comes again\n" * 9
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "s1", None])
        rows.append((k, text, lang, source))
    return rows + [(1000, None, "en", "hot"), (1001, "", None, None), (None, rows[0][1], "fr", "alone"), (5, rows[5][1], "en", "hot")]


def test_verdicts_equal_plain_version_and_sql(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, kept string, rows int"
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    expected = sorted(plain_judge(rows), key=str)
    assert sorted(map(tuple, quality.judge(docs).collect()), key=str) == expected
    assert 10 < sum(not r[-1] and not r[-2] for r in expected) < 100
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    unique.drop("kept", "rows").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    query = queries.op13_quality_rules(spark, str(tmp_path))
    table = con.execute(quality.op13_sql()).fetchall()
    assert sorted(table, key=str) == sorted(map(tuple, query.collect()), key=str)


def test_filter_keeps_whole_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, _row string, n int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(
        (k, t) for (k, t, *_), v in zip(rows, plain_judge(rows)) if v[-1] and k is not None)


def test_empty_table_and_only_failing_texts(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert quality.judge(spark.createDataFrame([], schema)).count() == 0
    row, = quality.judge(spark.createDataFrame([(1, "few words", None, "s")], schema)).collect()
    assert (row.n_words, row.base_failed, row.kept) == (2, True, False)


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a " * 60, "en", "s")], "doc_id long, text string, lang string, source string")
    for plan in (quality.measure(docs), quality.judge(docs), quality.sketches(quality.measure(docs))):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
