import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from pluvio.operators import models as M
from pluvio.operators.boosting import BoostedTrees, Tree, binned, softmax
from pluvio.operators.calibration import fit_sigmoids


def rows_of(spark, x, y):
    return spark.createDataFrame([(v.tolist(), float(k)) for v, k in zip(x, y)], "x array<double>, label_index double").select(array_to_vector("x").alias("features"), "label_index")


def plain_boosting(x, y, settings, edges):
    """The same trees, one at a time and without histograms."""
    bins, classes = binned(x, edges).astype(int), int(y.max()) + 1
    margins, rounds = np.zeros((len(x), classes)), []
    for _ in range(settings.rounds):
        p, trees = softmax(margins), []
        for k in range(classes):
            g, h = p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
            leaf = lambda own: -settings.learning_rate * g[own].sum() / (h[own].sum() + settings.reg_lambda)
            score = lambda own: g[own].sum() ** 2 / (h[own].sum() + settings.reg_lambda)

            def grow(own, depth):
                best = (1e-12, None, None)
                for f in range(bins.shape[1]) if depth < settings.max_depth else ():
                    for b in range(settings.max_bin - 1):
                        left, right = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                        if min(h[left].sum(), h[right].sum()) >= settings.min_child_weight:
                            gain = (score(left) + score(right) - score(own)) / 2 - settings.gamma
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, left, right)
                if best[1] is None:
                    return [(own, leaf(own))]
                return grow(best[1], depth + 1) + grow(best[2], depth + 1)
            trees.append(grow(np.ones(len(x), bool), 0))
        for k, leaves in enumerate(trees):
            for own, value in leaves:
                margins[own, k] += value
    return margins


def test_boosting_against_plain_trees(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0.2).astype(int) + (x[:, 1] * x[:, 2] > 0)).clip(0, 2)
    settings = BoostedTrees(rounds=4, max_depth=3, learning_rate=0.5, max_bin=8, min_child_weight=2.0)
    model = settings.fit(rows_of(spark, x, y).repartition(3))
    assert np.allclose(model.margins(x), plain_boosting(x, y, settings, model.edges), atol=1e-9)
    loss = np.array(model.train_loss)
    assert len(loss) == 4 and (np.diff(loss) < 0).all()
    want = -np.log(softmax(model.margins(x))[np.arange(300), y]).mean()
    assert np.isclose(loss[-1], want)
    out = model.transform(rows_of(spark, x, y)).select("prediction", "label_index", "probability").collect()
    assert np.allclose(sorted(r["prediction"] for r in out), sorted(softmax(model.margins(x)).argmax(1)))


def test_boosting_across_stages_and_missing_values(spark, monkeypatch):
    from pluvio.operators import boosting as B
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    x[::7, 1] = np.nan
    y = (x[:, 0] > 0).astype(int)
    data, settings = rows_of(spark, x, y), BoostedTrees(rounds=5, max_depth=2, max_bin=16, subsample=0.7)
    whole = settings.fit(data).margins(x)
    monkeypatch.setattr(B, "ROUNDS_PER_STAGE", 2)
    assert np.allclose(whole, settings.fit(data.repartition(4)).margins(x))
    with pytest.raises(ValueError):
        BoostedTrees(max_depth=11)
    with pytest.raises(ValueError):
        settings.fit(data.limit(0))


def test_boosting_stops_when_the_validation_loss_does(spark):
    """Labels that are mostly noise: training goes on to fit them, the held-out loss soon rises."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 5))
    y = np.where(rng.random(240) < 0.5, (x[:, 0] > 0).astype(int), rng.integers(0, 2, 240))
    train, held = rows_of(spark, x[:160], y[:160]), rows_of(spark, x[160:], y[160:])
    model = BoostedTrees(rounds=60, max_depth=4, learning_rate=0.5, max_bin=16, patience=4).fit(train, held)
    assert len(model.rounds) == int(np.argmin(model.validation_loss)) + 1 < 30
    assert model.validation_loss[-1] > min(model.validation_loss) and model.train_loss[-1] < model.train_loss[0]
    want = -np.log(softmax(model.margins(x[160:]))[np.arange(80), y[160:]]).mean()
    assert np.isclose(min(model.validation_loss), want)


def test_tree_places():
    tree = Tree(np.array([0, -1, 1, -1, -1, -1, -1]), np.array([2, 0, 1, 0, 0, 0, 0]), np.zeros(7))
    assert tree.place(np.array([[0, 0], [3, 0], [3, 2]], np.uint8), 2).tolist() == [1, 5, 6]


def test_sigmoids_against_a_plain_newton_fit(spark):
    rng = np.random.default_rng(6)
    f = rng.normal(size=500) * 2
    positive = [(rng.random(500) < 1 / (1 + np.exp(-1.5 * f - 0.4))).astype(int), (f > 0).astype(int)]  # the second can be parted
    rows = spark.createDataFrame([(k, float(v), int(p)) for k in (0, 1) for v, p in zip(f, positive[k])], "k int, margin double, positive int")
    fit, gradient = fit_sigmoids(rows.repartition(3), 2)
    assert np.abs(gradient).max() < 1e-4
    for k in (0, 1):
        n = positive[k].sum()
        t = np.where(positive[k] == 1, (n + 1) / (n + 2), 1 / (500 - n + 2))
        a, b = 0.0, np.log((500 - n + 1) / (n + 1))
        for _ in range(200):
            p = 1 / (1 + np.exp(a * f + b))
            g, w = np.array([((t - p) * f).sum(), (t - p).sum()]), p * (1 - p)
            a, b = np.array([a, b]) - 0.5 * np.linalg.solve(np.array([[(w * f * f).sum(), (w * f).sum()], [(w * f).sum(), w.sum()]]), g)
        assert np.allclose(fit[:, k], (a, b), rtol=1e-3)


def test_calibrated_margins(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 2)) + np.array([[0, 0], [3, 0], [0, 3]])[y]
    df = spark.createDataFrame([(v.tolist(), f"c{k}") for v, k in zip(x, y)], "x array<double>, label string")
    fitted = M.fit_classifier(M.Classifier("nusvc", {"max_iter": 30, "folds": 3}), df, "x", "label")
    out = fitted.predict(df).collect()
    scores = np.array([r["scores"] for r in out])
    assert np.allclose(scores.sum(1), 1) and ((scores > 0) & (scores < 1)).all() and (fitted.model.fit[0] < 0).all()
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.85
    # chances are near the shares that they promise
    top, hit = scores.max(1), np.array([r["prediction"] == r["label"] for r in out])
    assert abs(top.mean() - hit.mean()) < 0.08


def test_scores_of_one_vs_rest_are_chances(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 2)) + 2 * y[:, None]
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "x array<double>, label int")
    scores = np.array([r["scores"] for r in M.fit_classifier(M.Classifier("sgd", {"max_iter": 20}), df, "x", "label").predict(df).collect()])
    assert np.allclose(scores.sum(1), 1) and (scores >= 0).all()
