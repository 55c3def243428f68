"""Rates of the mixing operator against dense projected gradients, and domains that are hard to reach."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import mixing


def members(spark, p, n):
    return spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(n, p))], "doc_id long, tokens long, p array<double>")


def dense(p, n, goal, rounds, loose=()):
    """The same least squares with all rates held at once: accelerated projected gradients, restarted where they turn back."""
    z, m = n @ p, (p * n[:, None]).T @ p
    a = np.linalg.inv(m + mixing.RIDGE * np.diag(goal ** 2) / z.sum())
    size = np.linalg.eigvals(a @ m).real.max()
    x = y = np.ones(len(p))
    t = 1.0
    for _ in range(rounds):
        r = (n * y) @ p - goal
        for _ in range(100):
            for d in loose:
                rest = sum(a[d, j] * r[j] for j in range(len(r)) if j != d)
                r[d] = max(((n * y) @ p - goal)[d], -rest / a[d, d])
        new = np.maximum(0, y - p @ (a @ r) / size)
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        turned = (n * (y - new) * (new - x)).sum() > 0
        y = np.maximum(0, new + (t - 1) / grown * (new - x))
        x, t = new, 1.0 if turned else grown
    return x


def cases():
    rng = np.random.default_rng(4)
    n = rng.integers(20, 400, 1500)
    low, rare = rng.beta(0.3, 1.8, 1500), np.where(rng.random(1500) < 0.01, rng.random(1500), 0)
    three = lambda low, toxic: np.stack([(1 - low) * (1 - toxic), low * (1 - toxic), toxic], axis=1)
    return {"usual": (three(low, rng.beta(0.05, 3, 1500)), n), "scarce": (three(low, rare), n), "hardly there": (three(low, 1e-4 * rng.random(1500)), n),
            "absent": (three(low, 0 * low), n), "collinear": (np.stack([1 - low, 0.9 * low, 0.1 * low], axis=1), n)}


@pytest.mark.parametrize("kind", ["usual", "scarce", "hardly there", "absent", "collinear"])
@pytest.mark.parametrize("at_most", [(), ("toxic",)])
def test_rates_are_those_of_dense_projected_gradients(spark, kind, at_most):
    p, n = cases()[kind]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        history, totals = mixing.fit_rates(members(spark, p, n), mixing.TARGETS, at_most=at_most)
    x = mixing.replay(p, history)
    goal, live = np.array([t["target"] for t in totals]), p.sum(axis=0) > 0
    want = dense(p[:, live], n, goal[live], len(history), [2] if at_most and live[2] else [])
    assert (x >= 0).all() and abs(x - want).max() <= 1e-3 * max(1, want.max())
    got = (x * n) @ p
    assert np.allclose(got, [t["expected"] for t in totals], rtol=1e-6, atol=1e-3)
    reach = kind in ("usual", "scarce") or at_most
    assert all(t["met"] for t in totals) == bool(reach) and any("cannot meet" in str(w.message) for w in said) == (not reach)
    if reach:
        assert abs(got - goal)[:2].max() <= 2e-4 * goal.sum() and got[2] <= goal[2] + 2e-4 * goal.sum()
        assert not at_most or x.max() < 3
    if at_most:                                       # no more of it than there was
        assert got[2] <= (n @ p)[2] + 2e-4 * goal.sum()
    if kind == "hardly there" and not at_most:        # a miss of all of it costs the other domains little
        assert abs(got - goal)[:2].max() < 0.2 * goal.sum()


def test_plain_steps_reach_the_same_totals(spark):
    p, n = cases()["usual"]
    history, totals = mixing.fit_rates(members(spark, p, n), mixing.TARGETS)
    goal = np.array([t["target"] for t in totals])
    a = np.linalg.inv((p * n[:, None]).T @ p)
    x = np.ones(len(p))
    while abs((n * x) @ p - goal).max() > 1e-4 * goal.sum():
        x = np.maximum(0, x - p @ (a @ ((n * x) @ p - goal)))
    assert abs((n * mixing.replay(p, history)) @ p - (n * x) @ p).max() <= 3e-4 * goal.sum()


def test_columns_named_like_inner_ones_stay(spark):
    docs = spark.createDataFrame([(i, "fine words " * (i % 7), float(i), "u", "r") for i in range(60)], "doc_id long, text string, _u double, unit string, row string")
    model = mixing.DomainModel({}, np.zeros((0, 2)), np.zeros(2))
    got = mixing.resample(docs, model, [(np.array([0.5, 0.5]), 0.0)])
    assert got.columns == docs.columns and 60 < got.count() < 120
    assert got.where((F.col("_u") != F.col("doc_id")) | (F.col("unit") != "u") | (F.col("row") != "r")).count() == 0
