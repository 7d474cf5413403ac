"""The ranking of op3: all labelled documents and all their pairs, held against plain sums over pairs."""

import numpy as np

from terravow.llm import quality


def test_ranking_is_of_all_pairs(spark):
    random = np.random.default_rng(5)
    label = (random.random(2600) < 0.9).astype(int)  # more of one class than was once sampled
    x = random.normal(size=(2600, quality.FEATURES)) + label[:, None] * np.linspace(0, 0.6, quality.FEATURES)
    rows = spark.createDataFrame([(int(y), r.tolist()) for y, r in zip(label, x, strict=True)], "_label int, _x array<double>").repartition(5)
    found = quality.fit_ranking(rows)
    z = found.scaled(x)
    good, bad = z[label == 1], z[label == 0]
    weights = np.zeros(quality.FEATURES)
    for _ in range(8):
        p = 1 / (1 + np.exp(good @ weights[:, None] - (bad @ weights)[None, :]))
        q, n = p * (1 - p), p.size
        gradient = (p.sum(1) @ good - p.sum(0) @ bad) / n - 1e-3 * weights
        cross = good.T @ q @ bad
        hessian = ((good * q.sum(1)[:, None]).T @ good + (bad * q.sum(0)[:, None]).T @ bad - cross - cross.T) / n + 1e-3 * np.eye(len(weights))
        weights = weights + np.linalg.solve(hessian, gradient)
    assert np.abs(found.weights - weights).max() < 2e-3
    raw, zeros = np.sort(found.raw(x)), int((label == 0).sum())
    assert found.threshold == (raw[zeros - 1] + raw[zeros]) / 2


def test_ranking_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(int(i % 3 > 0), [float((i * (k + 3)) % 17 + (i % 3)) for k in range(quality.FEATURES)]) for i in range(300)], "_label int, _x array<double>")
    one, two = quality.fit_ranking(rows.repartition(1)), quality.fit_ranking(rows.repartition(7))
    assert (one.weights == two.weights).all() and one.threshold == two.threshold
