"""Dense networks: gradients against differences and a whole-table numpy version, losses, early stopping, a curved set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigscope.operators import models, networks
from rigscope.operators.networks import Shape


def _shape(loss, hidden="relu"):
    return Shape((3, 5, 4, 3 if loss == "reconstruction" else 1), loss, hidden)


def _data(rng, loss, n=200):
    x = rng.normal(size=(n, 3))
    y = x if loss == "reconstruction" else (rng.integers(0, 2, (n, 1)).astype(float) if loss == "binary" else 3 * rng.normal(size=(n, 1)))
    return x, y, rng.uniform(0.2, 3.0, n)


@pytest.mark.parametrize("loss", ["binary", "huber", "reconstruction"])
@pytest.mark.parametrize("hidden", ["relu", "tanh"])
def test_gradient_equals_differences(loss, hidden):
    rng = np.random.default_rng(4)
    shape = _shape(loss, hidden)
    x, y, w = _data(rng, loss)
    flat = shape.start(3) + rng.normal(size=len(shape.start(3))) * 0.1
    total, gradient = networks.loss_and_gradient(shape, flat, x, y, w)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (networks.loss_and_gradient(shape, flat + s, x, y, w, gradient=False)[0] for s in (step, -step))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=2e-2)


def test_losses_are_those_of_the_formulas():
    x = np.array([[1.0], [2.0], [-1.0]])
    flat = np.array([1.0, 0.5])                           # one layer: out = x + 0.5
    y, w = np.array([[1.2], [9.0], [0.0]]), np.array([1.0, 2.0, 3.0])
    huber = 0.5 * 0.3 ** 2 + 2 * (6.5 - 0.5) + 3 * 0.5 * 0.5 ** 2
    assert networks.loss_and_gradient(Shape((1, 1), "huber"), flat, x, y, w)[0] == pytest.approx(huber)
    t, p = np.array([1.0, 0.0, 1.0]), 1 / (1 + np.exp(-(x[:, 0] + 0.5)))
    bce = -(w * (t * np.log(p) + (1 - t) * np.log(1 - p))).sum()
    assert networks.loss_and_gradient(Shape((1, 1), "binary"), flat, x, t[:, None], w)[0] == pytest.approx(bce)


@pytest.mark.parametrize("loss", ["binary", "huber"])
def test_sums_over_partitions_equal_one_table(spark, loss):
    rng = np.random.default_rng(9)
    x, y, w = _data(rng, loss, 5000)
    rows = [(*map(float, a), float(b[0]), float(c)) for a, b, c in zip(x, y, w)] + [(None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, w double").repartition(7)
    shape = _shape(loss)
    flat = shape.start(1)
    for share in (0.0, 0.2):
        blocks = networks.to_blocks(df, ["a", "b", "c"], ["y"], F.col("w"), held_share=share)
        assert blocks.agg(F.sum("n")).first()[0] == 5000
        sums, gradient = networks.summed(blocks, shape, flat)
        more, again = networks.summed(blocks, shape, flat, fan_in=3)
        np.testing.assert_allclose(again, gradient, rtol=1e-9)
        total, whole = networks.loss_and_gradient(shape, flat, x, y, w)
        assert sums[0] + sums[2] == pytest.approx(total) and sums[1] + sums[3] == pytest.approx(w.sum())
        assert more == pytest.approx(sums)
        if share == 0.0:
            np.testing.assert_allclose(gradient, whole, rtol=1e-8, atol=1e-8)
        else:
            assert 0.1 < sums[3] / w.sum() < 0.3


def test_bottleneck_beats_pca_on_a_curve(spark):
    rng = np.random.default_rng(2)
    t = rng.uniform(-1.5, 1.5, 3000)
    x = np.stack([t, t ** 2 - 1, np.sin(2 * t)], axis=1) + rng.normal(size=(3000, 3)) * 0.02
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    cols = ["a", "b", "c"]
    fitted = networks.fit(networks.to_blocks(df, cols, cols), Shape((3, 16, 1, 16, 3), "reconstruction", "tanh"), epochs=120, rate=0.03,
                          patience=40)
    own = models.network_error(df, cols, fitted, "e").agg(F.avg("e")).first()[0]
    linear = models.fit_pca_detector(df, cols, 1)
    pca = df.select(linear.reconstruction_error().alias("e")).agg(F.avg("e")).first()[0]
    assert own < 0.6 * pca
    assert fitted.history[-1][1] < fitted.history[0][1]


def test_weights_balance_classes(spark):
    """One positive in twenty; with class weights the network finds most of them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 2))
    y = (x[:, 0] * x[:, 1] > 1.2).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    fitted = models.fit_network_classifier(df, ["a", "b"], "y", hidden=(16, 8), epochs=60, rate=0.05, patience=60)
    got = models.network_probability(df, ["a", "b"], fitted, "p").select("y", "p").toPandas()
    assert (got.p[got.y == 1] >= 0.5).mean() > 0.9 and (got.p[got.y == 0] < 0.5).mean() > 0.85


def test_early_stopping(spark):
    df = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), F.lit(2.0).alias("y"))
    fitted = networks.fit(networks.to_blocks(df, ["a"], ["y"]), Shape((1, 1), "huber"), epochs=40, rate=0.0, patience=3)
    assert len(fitted.history) == 4                        # nothing improves after the first measure
