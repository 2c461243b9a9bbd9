"""The pipeline: each stage on what its predecessor kept."""

import corpus_pipeline
from rigscope.llm import decontam, langid, simhash
from rigscope.llm.tables import materialize, read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        kept.append((name, len(ids), before.count()))
        if name == "near_duplicates":
            groups = simhash.near_duplicates(before).collect()
            assert sorted(ids) == sorted({r.component_id for r in groups})
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.contaminated(before, read(spark, SF, "benchmark")).collect()}
            assert set(ids) == {r.doc_id for r in before.collect()} - bad
        if name == "language_id":
            good = {r.doc_id for r in langid.identify(before).collect() if not r.rejected}
            assert set(ids) == good
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(ids)
    assert dict((n, a <= b) for n, a, b in kept) == {n: True for n, _ in corpus_pipeline.STAGES[:-1]}
    assert kept[1][1] == kept[1][2] and kept[2][1] < kept[2][2]


def test_empty_documents(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


def test_odd_documents_pass_every_stage(spark):
    """Null, empty and very long texts, null ids, repeated rows and columns whose names the stages use themselves."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, gone string, code string, key string, "
              "component_id string, fingerprint string, lang_pred string, found string, item_id string, score double")
    words = "the tion and ing of that is with for was by this from are".split()
    prose = [" ".join(words[(i * k + k) % 14] for k in range(60)) for i in range(1, 30)]
    rows = [(i, t, "en", f"s{i % 7}") for i, t in enumerate(prose)]
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, "12 34", "en", "s1"), (103, " \n\t\n", "fr", "s2"),
             (104, (prose[0] + "\n") * 4000, "en", "s2"), (None, prose[1] + " and more of it", "en", "s3"),
             (None, None, None, None), (5, prose[5], "en", "s5"), (105, prose[5], "en", "s6")]
    docs = spark.createDataFrame([(d, t, la, s, len(t or ""), *["clash"] * 8, 0.5) for d, t, la, s in rows], schema)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-odd-{name}")
        assert docs.columns == columns and docs.count() > 0
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    assert 105 not in kept and kept.count(5) == 2 and None in kept and not {100, 101, 102, 103} & set(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(kept) and all(r.piece_ids for r in last if r.n_chars)


def test_short_lines_of_many_sites_go(spark):
    rows = [(i, f"the text of document {i}\nRead more\n\n\t\n}}\n{'Log in' if i < 4 else 'own'}", "en", f"s{i}", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {i: t if not i else t.replace("Read more\n", "").replace("}\n", "") for i, t, *_ in rows}
