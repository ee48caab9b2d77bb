"""K-means of many k and starts in shared passes, against one run after the other."""

import numpy as np
import pytest

from termlens.operators import clustering


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")


def plain(x, k, starts, seed, turns=50):
    """The centers of the cheapest run and its cost; one run after the other."""
    x = x[np.lexsort(x.T)]
    best = None
    for r in range(starts):
        c = clustering.spread_starts(x, k, np.random.default_rng([seed, k, r]))
        for _ in range(turns):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= 1e-4 * x.var(axis=0).mean():
                break
        cost = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
        if best is None or cost < best[1]:
            best = (c, cost)
    return best


def test_shared_passes_equal_single_runs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.7, (40, 3)) for c in (0, 4, 9, 15)])
    passes = []
    one = clustering._pass
    monkeypatch.setattr(clustering, "_pass", lambda points, models: passes.append(len(models)) or one(points, models))
    got = clustering.lloyd(frame(spark, x), [2, 4, 5], 6, seed=9)
    for k in (2, 4, 5):
        centers, cost = plain(x, k, 6, 9)
        assert got[k][1] == pytest.approx(cost) and np.allclose(got[k][0], centers)
    assert len(passes) <= 51 and passes[0] == 18 and passes[-1] == 18 and passes == sorted(passes[:-1], reverse=True) + [18]


def test_choice_of_k(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (30, 4)) for c in (0, 5, 11)])
    k, score, found = clustering.pick_k(frame(spark, x), range(2, 6), 4)
    labels = np.array([r["cluster"] for r in found.orderBy("id").collect()])
    assert k == 3 and score == pytest.approx(clustering.silhouette_blocks(x, labels))
    assert len(set(labels[:30])) == len(set(labels[30:60])) == len(set(labels[60:])) == 1
    several = clustering.silhouettes(clustering.assigned(frame(spark, x), [x[:2], x[:5]]), block=20).orderBy("place").collect()
    for r, m in zip(several, (x[:2], x[:5])):
        own = ((x[:, None] - m[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert r["silhouette"] == pytest.approx(clustering.silhouette_blocks(x, own))


def test_odd_points(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0, None]), (None, [1.0, 2.0]), (3, [])], "id long, vector array<double>")
    assert clustering.pick_k(none, [2, 3], 2) is None
    same = frame(spark, np.ones((5, 2)))
    k, score, found = clustering.pick_k(same, [3, 2], 2)
    assert (k, score) == (2, 0.0) and {r["cluster"] for r in found.collect()} == {0}


def test_all_points_meet_on_a_grid(spark, monkeypatch):
    """Several lines and tiles, text ids, equal points and a cluster of one against the plain silhouette; what is shuffled are blocks."""
    monkeypatch.setattr(clustering.packing, "ROWS", 40)
    x = np.random.default_rng(7).normal(0, 1, (203, 5))
    x[20:30] = x[3]
    labels = np.random.default_rng(8).integers(0, 4, (203, 2))
    labels[50, 1] = 9
    rows = spark.createDataFrame([(f"p{i}", [float(v) for v in r], [int(c) for c in l]) for i, (r, l) in enumerate(zip(x, labels))], "id string, vector array<double>, clusters array<int>")
    kept = []
    grid = clustering.packing.grid
    monkeypatch.setattr(clustering.packing, "grid", lambda a, b, *r, **k: kept.append(a) or grid(a, b, *r, **k))
    got = {r["place"]: r["silhouette"] for r in clustering.silhouettes(rows, block=16).collect()}
    assert got == {p: pytest.approx(clustering.silhouette_blocks(x, labels[:, p]), abs=1e-9) for p in (0, 1)}
    assert kept[0].count() < len(x)
