"""The inverted file against all pairs, how much it looks at, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.operators import nearest


def plain(items, table, cutoff, other):
    out = {}
    for i, x in items:
        best = None
        for j, y in table:
            if x is None or y is None or len(x) != len(y) or other and i == j or not any(x) or not any(y):
                continue
            s = round(float(np.dot(x, y) / np.sqrt(np.dot(x, x)) / np.sqrt(np.dot(y, y))), 8)
            if best is None or (s, -j) > best:
                best = (s, -j)
        if best and best[0] >= cutoff:
            out[i] = (-best[1], best[0])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], "x", 1) for i, v in rows], "id long, vector array<double>, ring string, part int")


def clustered(rng, n, dim, groups, spread):
    c = rng.normal(0, 1, (groups, dim))
    return c[rng.integers(0, groups, n)] + spread * rng.normal(0, 1, (n, dim))


@pytest.mark.parametrize("other", [False, True])
def test_nearest_equals_all_pairs(spark, monkeypatch, other):
    monkeypatch.setattr(nearest, "RINGS", 3)
    rng = np.random.default_rng(3 + other)
    x = clustered(rng, 400, 6, 9, 0.2).tolist()
    x[5], x[17], x[300], x[301] = x[2], x[2], x[2], [0.0] * 6
    table = list(enumerate(x)) + [(1000 + i, x[7]) for i in range(40)] + [(2000, None), (2001, [1.0, 2.0]), (2002, [2.0, 4.1]), (2003, [1.0, None, 2.0])]
    items = table if other else [(i, v) for i, v in enumerate(clustered(rng, 150, 6, 9, 0.6).tolist())] + [(500, None), (501, [1.0, 2.1]), (502, [1.0] * 5), (503, [0.0] * 6)]
    got = {r["item_id"]: (r["match_id"], round(r["score"], 8)) for r in nearest.nearest(frame(spark, items), frame(spark, table), 0.5, other, block=16).collect()}
    want = plain([(i, v) for i, v in items if v is None or None not in v], [(i, v) for i, v in table if v is None or None not in v], 0.5, other)
    assert got.keys() == want.keys()
    for i, (match, score) in want.items():
        assert got[i][1] == pytest.approx(score, abs=2e-8) and got[i][0] == match, i


def test_few_parts_are_looked_at(spark):
    rng = np.random.default_rng(8)
    table, items = clustered(rng, 3000, 16, 40, 0.15), clustered(np.random.default_rng(8), 200, 16, 40, 0.15)
    parts, cells = nearest.index(nearest._different(nearest._good(frame(spark, enumerate(table.tolist())))), 32)
    asked = nearest._good(frame(spark, enumerate(items.tolist()))).select(F.col("id").alias("item_id"), "size", "vector")
    first = nearest._met(nearest._asks(asked, cells, 0.65, True), parts, False, 32)
    rest = nearest._asks(asked.join(first.select("item_id", "score"), "item_id", "left"), cells, 0.65, False)
    sizes = parts.groupBy("size", "ring", "part").count()
    compared = rest.join(sizes, ["size", "ring", "part"]).agg(F.sum("count")).first()[0] or 0
    print(f"{compared} pairs of {len(table) * len(items)} in the second turn")
    assert compared < 0.2 * len(table) * len(items)
    assert sizes.agg(F.max("count")).first()[0] <= 4 * 32


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1])])
    assert nearest.nearest(none, some, 0.5).collect() == [] and nearest.nearest(some, none, 0.5).collect() == []
    assert {r["item_id"]: r["match_id"] for r in nearest.nearest(some, some, 0.5, other=True).collect()} == {1: 2, 2: 1}
    assert nearest.nearest(some.where("id = 1"), some.where("id = 1"), 0.5, other=True).collect() == []


def test_vectors_without_clusters_meet_on_a_grid(spark, monkeypatch):
    """The bounds leave nearly every part: what is sent grows with the rows, whatever the parts."""
    monkeypatch.setattr(nearest.packing, "ROWS", 64)
    monkeypatch.setattr(nearest, "TILE", 32)
    x = np.random.default_rng(5).normal(0, 1, (600, 12))
    x[9], x[400], x[17], x[18] = x[3], x[3], 2 * x[3], 0
    monkeypatch.setattr(nearest, "_asks", lambda *a, asks=nearest._asks, **b: asks(*a, **b) if a[3] else pytest.fail("parts were asked one by one"))
    for other in (False, True):
        table = list(enumerate(x.tolist()))
        items = table if other else [(i, v) for i, v in enumerate((x[:200] + 0.5).tolist())]
        got = {r["item_id"]: (r["match_id"], round(r["score"], 8)) for r in nearest.nearest(frame(spark, items), frame(spark, table), 0.3, other, block=16).collect()}
        want = plain(items, table, 0.3, other)
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=2e-8) for i in want)


@pytest.mark.parametrize("asks", [0, 10**6])
def test_ties_at_four_places(spark, monkeypatch, asks):
    """Of scores that are equal to four places the least id stands, also below a greater cosine; the cutoff holds for that cosine."""
    monkeypatch.setattr(nearest, "ASKS", asks)
    turn = lambda c: [c, (1 - c * c) ** 0.5]
    table = [(7, turn(0.90001)), (3, turn(0.89997)), (1, turn(0.8999)), (9, turn(0.900049))]
    got = nearest.nearest(frame(spark, [(50, [1.0, 0.0])]), frame(spark, table), 0.3, block=2, places=4).collect()
    assert [(r["match_id"], r["score"]) for r in got] == [(3, 0.9)]
    assert nearest.nearest(frame(spark, [(50, [1.0, 0.0])]), frame(spark, table), 0.90005, block=2, places=4).collect() == []
    assert len(nearest.nearest(frame(spark, [(50, [1.0, 0.0])]), frame(spark, table), 0.90004, block=2, places=4).collect()) == 1
