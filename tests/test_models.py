"""Fitted-model properties (rows-only queries): score ranges, threshold share, forward pass = MLP, AUC = rank sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from rigscope.operators import cache, evaluate, models


def test_pca_scores_and_threshold(spark):
    df = E.queries()["pca_anomaly_scores"](spark, SF001).toPandas()
    assert (df["anomaly_score"] >= 0).all()
    assert df["threshold"].nunique() == 1


def test_dense_forward_equals_mlp_probability(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)],
                               "a double, b double, c double, y double")
    m = models.fit_classifier(df, ["a", "b", "c"], "y", kind="mlp", hidden=(5, 4), max_iter=30)
    p = models.failure_probability(m, df).select("a", "b", "c", "confidence_score")
    layers = models.mlp_layers(m.stages[-1])
    f = models.dense_forward(p, ["a", "b", "c"], layers, ["sigmoid"] * (len(layers) - 1) + ["softmax"])
    got = f.toPandas()
    np.testing.assert_allclose(got["nn_out"], got["confidence_score"], rtol=1e-9, atol=1e-12)
    assert ((got["confidence_score"] >= 0) & (got["confidence_score"] <= 1)).all()


def test_evaluator_auc_equals_rank_sum(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    import pandas as pd

    r = pd.Series(s).rank()
    n1, n0 = y.sum(), len(y) - y.sum()
    expected = (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert evaluate.auc(df, "y", "s") == pytest.approx(expected, abs=1e-12)


def test_huber_recovers_linear_target(spark):
    df = spark.range(400).select((F.col("id") / 40.0).alias("x"), F.rand(9).alias("n"))
    df = df.withColumn("y", F.col("x") * 3 + 1)
    m = models.fit_regressor(df, ["x", "n"], "y")
    coef = m.stages[-1].coefficients
    assert coef[0] == pytest.approx(3.0, abs=1e-3)


def test_balanced_replicas(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "y double")
    out = {r["y"]: r["count"] for r in models.balanced_replicas(df, "y").groupBy("y").count().collect()}
    assert out == {0.0: 9, 1.0: 9}


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_weighted_classifiers(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] > 1.0).astype(float)                      # ~16 % positives
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    m = models.fit_classifier(df, ["a", "b"], "y", kind=kind, max_iter=20)
    p = models.failure_probability(m, df).toPandas()
    assert p["confidence_score"].between(0, 1).all()
    auc = evaluate.auc(spark.createDataFrame(p[["y", "confidence_score"]]), "y", "confidence_score")
    assert auc > 0.9


def test_balance_is_exact_to_the_fraction(spark):
    df = spark.range(24_000).select((F.col("id") % 12 < 5).cast("double").alias("y"), "id")      # 10,000 of 24,000: ratio 1.4
    out = {r["y"]: r["count"] for r in models.balanced_replicas(df, "y").groupBy("y").count().collect()}
    assert out[0.0] == 14_000 and out[1.0] == pytest.approx(14_000, rel=0.02)


def test_network_is_fitted_on_a_bounded_number_of_rows(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") / 100).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    seen, plain = [], models.balanced_replicas
    monkeypatch.setattr(models, "balanced_replicas", lambda d, *a: seen.append(d.count()) or plain(d, *a))
    models.fit_classifier(df, ["x"], "y", kind="mlp", hidden=(2,), max_iter=1, max_rows=500)
    assert 350 < seen[0] < 650


def test_missing_features_are_left_out_of_fits_and_zero_in_scores(spark):
    rows = [(float(k), float(k % 5), 2.0 * k + 1) for k in range(200)]
    clean = spark.createDataFrame(rows, "a double, b double, y double")
    holes = clean.unionByName(spark.createDataFrame([(None, 1.0, 5.0), (3.0, None, -99.0), (1.0, 1.0, None)], clean.schema))
    for kind in ("huber", "gbt"):
        m, n = (models.fit_regressor(d, ["a", "b"], "y", kind=kind, max_iter=20) for d in (clean, holes))
        probe = spark.createDataFrame([(7.0, 2.0), (None, None)], "a double, b double")
        got = [[r["days_raw"] for r in models.predict_days(x, probe).collect()] for x in (m, n)]
        assert got[0] == pytest.approx(got[1]) and got[0][0] == pytest.approx(15.0, abs=8.0 if kind == "gbt" else 0.01)


def test_aucs_of_several_scores_in_one_pass(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    scores = {"a": np.round(rng.random(400) + y * 0.3, 1), "b": rng.random(400), "tied": np.zeros(400)}
    df = spark.createDataFrame([(int(t), *(float(s[k]) for s in scores.values())) for k, t in enumerate(y)],
                               "y int, a double, b double, tied double")
    got = evaluate.aucs(df, "y", list(scores))
    for name, s in scores.items():
        wins = (s[y == 1][:, None] > s[y == 0][None]).mean() + (s[y == 1][:, None] == s[y == 0][None]).mean() / 2
        assert got[name] == pytest.approx(wins, abs=1e-12)
    assert np.isnan(evaluate.auc(df.filter("y = 1"), "y", "a"))


def test_permuted_values_are_a_permutation(spark):
    df = spark.range(500).select(F.col("id").alias("record_id"), (F.col("id") * 2.0).alias("f"), F.lit(1.0).alias("same"))
    got = evaluate.permuted(df, ["f", "same"], "record_id").collect()
    assert sorted(r["f_perm"] for r in got) == sorted(r["f"] for r in got) and {r["same_perm"] for r in got} == {1.0}
    assert sum(r["f_perm"] == r["f"] for r in got) < 20


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4099])
def test_places_are_dealt_one_to_one(spark, n):
    keys = {f"p{i}": evaluate.round_keys(7, i) for i in (0, 1)}
    rows = evaluate.permuted_places(spark.range(n), "id", n, keys).collect()
    for c in ("p0", "p1"):
        assert sorted(r[c] for r in rows) == list(range(n))
    if n > 90:
        assert sum(r["p0"] == r["p1"] for r in rows) < n / 10 and sum(r["p0"] == r["id"] for r in rows) < n / 10
        steps = np.diff([r["p0"] for r in rows])
        assert len(set(steps.tolist())) > n / 4                  # no shift, no stride


def test_one_numbering_for_all_features(spark):
    df = spark.range(300).select(F.col("id").alias("record_id"), *[(F.col("id") * k).cast("double").alias(f"f{k}") for k in range(1, 6)])
    kept = len(cache._KEPT)
    got = evaluate.permuted(df, [f"f{k}" for k in range(1, 6)], "record_id")
    assert len(cache._KEPT) == kept + 1 and got.count() == 300


def test_importances_keep_only_columns_that_are_read(spark):
    from conftest import SF001
    from rigscope.operators import cache
    from rigscope.plans import catalog

    cache.release()
    rows = catalog.classifier_importance(spark, SF001).collect()
    assert {r.feature for r in rows} == set(catalog.SPEC.features)
    kept = [set(f.columns) for f in cache._KEPT]
    assert kept and not any({"failure_type", "timestamp", "next_failure_us"} & names for names in kept)


def test_sample_of_equal_rows_holds_every_kind(spark, monkeypatch):
    """Two features of two values make four kinds of rows: a hash of the values would keep or lose each kind whole."""
    df = spark.range(4000).select((F.col("id") % 2).cast("double").alias("a"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("b"))
    df = df.withColumn("y", (F.col("a") != F.col("b")).cast("double"))
    seen, plain = [], models.balanced_replicas
    monkeypatch.setattr(models, "balanced_replicas", lambda d, *a: seen.extend(d.groupBy("a", "b").count().collect()) or plain(d, *a))
    for part in (400, 1000):
        seen.clear()
        model = models.fit_classifier(df, ["a", "b"], "y", kind="mlp", hidden=(8,), max_iter=200, max_rows=part)
        assert len(seen) == 4 and all(0.6 * part / 4 < r["count"] < 1.4 * part / 4 for r in seen)
        wrong = models.failure_probability(model, df).filter((F.col("confidence_score") >= 0.5) != (F.col("y") == 1.0))
        assert wrong.count() == 0


def test_recovered_labels_come_from_a_fit_on_all_rows(spark, scratch, monkeypatch):
    from rigscope.plans import catalog

    rows = [(i, 1_700_000_000 + i, i % 7, "view", None if i % 50 == 0 else float(i % 100), None if i % 41 == 0 else f'{{"k": {i * 13 % 101}}}')
            for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").write.parquet(f"{scratch}/events.parquet")
    bounded = (*models.fit_classifier.__defaults__[:-1], 60)       # as if these rows were more than a bounded fit takes
    monkeypatch.setattr(models.fit_classifier, "__defaults__", bounded)
    fitted, plain = [], models.balanced_replicas
    monkeypatch.setattr(models, "balanced_replicas", lambda d, *a: fitted.append(d.count()) or plain(d, *a))

    got = {r["record_id"]: (r["mlp_class"], r["gbt_class"]) for r in catalog.classifier_recovers_labels(spark, scratch).collect()}
    want = {}
    for i, _, _, _, value, props in rows:
        k = i * 13 % 101
        known = props is not None and k >= 10 and value is not None      # the reading is lost below a signal of 10
        want[i] = (int((k >= 50) != (known and value >= 50)),) * 2 if props is not None else (0, 0)
    assert got == want
    assert fitted == [sum(props is not None for *_, props in rows)]
