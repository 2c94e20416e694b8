"""Fits that stop early, keep their best state and are taken up again."""

import numpy as np
import pytest

from recallgrid.operators import em
from recallgrid.operators.heads import trained_head


def frame(spark, x, y, first=0):
    return spark.createDataFrame([(first + i, None if c is None else int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))], "pos_id long, y int, x array<double>").repartition(3)


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_head_keeps_its_best_state(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, 6))
    y = rng.integers(0, 3, 120)
    x = centres[y] + rng.normal(size=(120, 6))
    noise = rng.integers(0, 3, 40)  # labels of the tuning rows have nothing to do with them: it must stop at once
    train, real = frame(spark, x[:80], [5 * c for c in y[:80]]), frame(spark, x[80:], [5 * c for c in y[80:]])
    got, history = trained_head(train, real, real, epochs=12, rate=0.1)
    head, m, v, want = np.zeros((3, 6)), 0, 0, []  # the same in one process
    for t in range(1, len(history) + 1):
        p, q = softmax(x[:80] @ head.T), softmax(x[80:] @ head.T)
        want.append((-np.log(p[np.arange(80), y[:80]]).mean(), -np.log(q[np.arange(40), y[80:]]).mean(), q[np.arange(40), y[80:]]))
        g = (p - np.eye(3)[y[:80]]).T @ x[:80] / 80
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        head = head - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert [(h["train_nll"], h["ct_nll"]) for h in history] == [pytest.approx(w[:2]) for w in want]
    best = min(want, key=lambda w: w[1])[2]
    assert [r["p_head"] for r in got.orderBy("pos_id").collect()] == pytest.approx(best.tolist())
    bad = frame(spark, x[80:], [5 * c for c in noise])
    _, short = trained_head(train, bad, bad, epochs=30, rate=0.5, patience=2)
    assert len(short) < 31 and min(h["ct_nll"] for h in short[-2:]) >= min(h["ct_nll"] for h in short) - 1e-5


def test_head_on_unknown_null_and_no_labels(spark):
    x = np.eye(4)
    train = frame(spark, x, [1, 2, None, 1])
    got, history = trained_head(train, train, frame(spark, x, [1, 9, None, 2]), epochs=2)
    p = [r["p_head"] for r in got.orderBy("pos_id").collect()]
    assert len(history) == 3 and p[0] > 0 and p[1] == p[2] == 0 and p[3] > 0
    got, history = trained_head(train.limit(0), train, train)
    assert history == [] and {r["p_head"] for r in got.collect()} == {0.0}


def test_mixture_goes_on_from_a_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = frame(spark, np.r_[rng.normal(size=(40, 3)), rng.normal(4, 1, size=(40, 3))], [0] * 80)
    start = em.Mixture("diag", np.full(2, 0.5), np.array([[0.0] * 3, [1.0] * 3]), np.ones((2, 3)))
    whole, history = em.fit(rows, start, 5, every=2, path=str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["iteration=2", "iteration=4", "iteration=5"]
    again, later = em.fit(rows, em.load(spark, str(tmp_path), 2), 3)
    assert [h["mean_ll"] for h in later] == pytest.approx([h["mean_ll"] for h in history[2:]])
    for a, b in ((whole, again), (whole, em.load(spark, str(tmp_path), 5))):
        assert np.allclose(a.means, b.means) and np.allclose(a.var, b.var) and np.allclose(a.weights, b.weights)


def test_slices_add_up(spark, monkeypatch):
    monkeypatch.setattr(em, "SLICE", 4)
    parts = spark.createDataFrame([(b["slice"], b["s"]) for k in range(5) for t in em.sliced(np.arange(10.0) * k) for b in t.to_pylist()], em.SLICES)
    assert em.added(parts, 10).tolist() == (np.arange(10.0) * 10).tolist()
