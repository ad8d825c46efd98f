"""Boosted trees: sums and leaves by hand, against a plain fit in memory, and what they learn."""

import numpy as np
import pytest

from tidemark.operators import boosting


def table(spark, n=600, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = (x[:, 0] + 0.5 * (x[:, 1] > 0.3) + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(float(a), float(b), None if i % 50 == 0 else float(c), int(k)) for i, ((a, b, c), k) in enumerate(zip(x, y, strict=True))] + [(1.0, 1.0, 1.0, None)]
    return rows, spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(parts)


def test_leaves_by_hand(spark):
    rows = [(0.0, 0)] * 30 + [(0.0, 1)] * 10 + [(1.0, 1)] * 40
    model = boosting.fit(spark.createDataFrame(rows, "x double, y int"), ["x"], "y", trees=1, depth=1, rate=0.5, l1=2.0, l2=3.0, least=1.0, rows=1.0, features=1.0, n_bins=4)
    t = model.trees[0]
    # at margin 0 gradients are 1/2 - y and hessians 1/4: left 30 - 10 halves and 40 quarters, right 40 halves down
    assert t.feature[0] == 0 and t.value[1] == pytest.approx(-0.5 * (10 - 2) / (10 + 3)) and t.value[2] == pytest.approx(0.5 * (20 - 2) / (10 + 3))
    assert t.gain[0] == pytest.approx(8**2 / 13 + 18**2 / 13 - 8**2 / 23) and model.importances() == {"x": 1.0}
    p = {r.x: r.probability for r in boosting.predicted(model, spark.createDataFrame(rows, "x double, y int")).collect()}
    assert p[1.0] == pytest.approx(1 / (1 + np.exp(-t.value[2]))) and p[0.0] < 0.5


def plain(rows, model, trees, depth, rate, l1, l2, least, n_bins):
    """The same boosting in memory on all rows and features."""
    x = np.array([[0.0 if v is None else v for v in r[:3]] for r in rows if r[3] is not None])
    y = np.array([r[3] for r in rows if r[3] is not None], float)
    bins, margin, made = model.bins(x), np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, tree = p - y, p * (1 - p), boosting.Tree.empty(depth)
        for level in range(depth):
            at = tree.place(bins, level) - (2**level - 1)
            sums = np.zeros((2**level, 3, n_bins, 2))
            for i in np.flatnonzero(at >= 0):
                for j in range(3):
                    sums[at[i], j, bins[i, j]] += g[i], h[i]
            if not boosting.split(tree, level, sums, np.ones(3, bool), l1, l2, least, rate):
                break
        margin = margin + tree.value[tree.place(bins, depth)]
        made.append(tree)
    return made


def test_distributed_sums_equal_a_fit_in_memory(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS", 70)  # several blocks a task
    monkeypatch.setattr(boosting, "KEEP", 2)  # margins are renewed on the way
    monkeypatch.setattr(boosting, "PARTS", 3)  # sums are added up on executors
    rows, df = table(spark)
    rule = {"trees": 5, "depth": 3, "rate": 0.3, "l1": 0.1, "l2": 1.0, "least": 2.0, "n_bins": 16}
    model = boosting.fit(df, ["a", "b", "c"], "y", rows=1.0, features=1.0, **rule)
    for t, want in zip(model.trees, plain(rows, model, **rule), strict=True):
        assert (t.feature == want.feature).all() and (t.split == want.split).all() and np.allclose(t.value, want.value) and np.allclose(t.gain, want.gain)


def test_shares_do_not_depend_on_partitions(spark):
    _, one = table(spark, parts=1)
    _, many = table(spark, parts=7)
    a, b = (boosting.fit(df, ["a", "b", "c"], "y", 6, 3) for df in (one, many))
    assert all((s.feature == t.feature).all() and np.allclose(s.value, t.value) for s, t in zip(a.trees, b.trees, strict=True))
    assert any((t.feature >= 0).any() for t in a.trees) and a.importances()["a"] == max(a.importances().values())


def test_it_learns_and_penalties_hold_back(spark):
    _, df = table(spark, 1500)
    model = boosting.fit(df, ["a", "b", "c"], "y", 25, 3, 0.2)
    _, test = table(spark, 800, 9)
    made = boosting.predicted(model, test).filter("y IS NOT NULL")
    assert made.filter("prediction = y").count() / made.count() > 0.85
    held = boosting.fit(df, ["a", "b", "c"], "y", 3, 3, 0.2, l1=1e6)
    assert all((t.value == 0).all() for t in held.trees)
    assert boosting.fit(df.limit(0), ["a"], "y").trees == [] and boosting.predicted(boosting.fit(df.limit(0), ["a"], "y"), test).first().probability == 0.5
