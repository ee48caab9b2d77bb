"""The nearest vector of another table by cosine: exact, with an inverted file and bounds on angles.

Different vectors of the table are dealt to cells around centroids (spherical k-means on a bounded sample), and within a cell to
rings by their angle to the centroid. Angles obey the triangle inequality, so a vector of a ring between the angles ``lo`` and ``hi``
is at least ``max(0, lo - t, t - hi)`` away from an item at angle ``t`` from the centroid. Each item first looks at the ring
nearest to it, which gives it a score to beat; then at those rings only whose bound reaches that score and the cutoff. Where the
bounds leave more than ``ASKS`` parts an item, which is what vectors without clusters do, all items meet all vectors instead: packed
blocks on a grid, of which a task multiplies one cell. The grid has a fixed number of lines until a block reaches ``BYTES``, so what
is shuffled grows with the rows, not with the pairs.

The driver holds centroids and rings (``CELLS`` times ``RINGS`` at most), never vectors of the table. Rings are split into parts of about
``BLOCK`` rows and what asks for a part into slots of as many, so no group is larger, whatever is hot; equal vectors are one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.operators import packing
from termlens.sources import stage

#: Rows that the centroids are fitted on, in expectation; cells and rings of a cell at most; rows of a part or a slot.
SAMPLE, CELLS, RINGS, BLOCK = 4096, 512, 16, 1024
#: Decimal places to which scores are compared, and the slack of a bound.
PLACES, SLACK = 9, 1e-7
#: Parts that an item asks for, in the mean, up to which vectors are sent to parts one by one.
ASKS = 4
#: Rows of a product of matrices at a time.
TILE = 1024
NONE = -(1 << 63)


def _good(rows: DataFrame) -> DataFrame:
    """``(id, size, vector)`` of rows that can match: ids, no null within, not of length zero."""
    rows = rows.where("id is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = rows.select("id", F.size("vector").alias("size"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where("exists(vector, x -> x <> 0)")


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=float)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def centroids(points: np.ndarray, k: int, turns: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit points by cosine; empty cells keep their centroid."""
    c = points[np.random.default_rng(seed).choice(len(points), size=min(k, len(points)), replace=False)]
    for _ in range(turns):
        own = (points @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, points)
        length = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], c)
    return c


def _angles(units: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ c.T, -1.0, 1.0))


class Cells:
    """Centroids by vector size, and the rings that are there: cell, ring, parts, least and greatest angle."""

    def __init__(self, by_size: dict[int, np.ndarray], widest: dict[tuple[int, int], float] | None = None, rings: dict[int, np.ndarray] | None = None):
        self.by_size, self.widest, self.rings = by_size, widest or {}, rings or {}

    def dealt(self, size: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and angle of each unit vector; a size that the sample lacks has one cell around the first axis."""
        c = self.by_size.get(size)
        a = _angles(units, np.eye(1, size) if c is None else c)
        cell = a.argmin(axis=1)
        return cell, a[np.arange(len(a)), cell]

    def bounds(self, size: int, units: np.ndarray) -> np.ndarray:
        """For each unit vector and ring of its size the greatest cosine that is possible."""
        r = self.rings[size]
        c = self.by_size.get(size)
        a = _angles(units, np.eye(1, size) if c is None else c)[:, r["cell"]]
        return np.cos(np.maximum(0.0, np.maximum(r["lo"][None, :] - a, a - r["hi"][None, :])))


def _by_size(batch: pd.DataFrame):
    for size, own in batch.groupby("size", sort=False):
        yield int(size), own, _units(own["vector"])


def _placed(different: DataFrame, cells: Cells) -> DataFrame:
    """``(size, cell, angle, id, second, vector)`` of the different vectors of the table."""

    def run(batches):
        for batch in batches:
            for size, own, units in _by_size(batch):
                cell, angle = cells.dealt(size, units)
                yield pd.DataFrame({"size": size, "cell": cell.astype(np.int32), "angle": angle, "id": own["id"], "second": own["second"], "vector": list(units)})

    return different.mapInPandas(run, "size int, cell int, angle double, id long, second long, vector array<double>")


def index(different: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Cells]:
    """The different vectors ``(id, second, size, vector)`` with ``ring`` and ``part``, and the cells."""
    n = different.count()
    cells = Cells({})
    near = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < F.lit((1 << 30) * SAMPLE // max(n, SAMPLE))
    found = different.where(near).select("size", "vector").toPandas()  # SAMPLE different vectors, in expectation
    for size, own in found.groupby("size"):
        units = _units(own["vector"])
        order = np.lexsort(units.T)
        cells.by_size[int(size)] = centroids(units[order], min(CELLS, max(1, int(n**0.5))))
    placed = _placed(different, cells)
    # One row for each cell, then one for each ring: both bounded by the parameters (and the number of sizes).
    for r in placed.groupBy("size", "cell").agg(F.max("angle").alias("w"), F.count("*").alias("n")).collect():
        cells.widest[(r["size"], r["cell"])] = max(r["w"], 1e-9) / min(RINGS, -(-r["n"] // block))

    def ringed(batches):
        for batch in batches:
            widths = np.array([cells.widest[k] for k in zip(batch["size"], batch["cell"])])
            ring = np.minimum(RINGS - 1, (batch["angle"].to_numpy() / widths).astype(np.int32)) if len(batch) else np.zeros(0, np.int32)
            yield batch.assign(ring=batch["cell"] * RINGS + ring)[["size", "ring", "angle", "id", "second", "vector"]]

    rows = placed.mapInPandas(ringed, "size int, ring int, angle double, id long, second long, vector array<double>")
    stats = rows.groupBy("size", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")).orderBy("size", "ring").toPandas()
    stats["cell"], stats["parts"] = stats["ring"] // RINGS, -(-stats["n"] // block)
    cells.rings = {int(s): own.to_records(index=False) for s, own in stats.groupby("size")}
    parts = {(int(s), int(r)): int(p) for s, r, p in zip(stats["size"], stats["ring"], stats["parts"])}

    def split(batches):
        for batch in batches:
            own = np.array([parts[k] for k in zip(batch["size"], batch["ring"])], dtype=np.int64)
            yield batch.assign(part=batch["id"] % np.maximum(own, 1) if len(batch) else own)[["size", "ring", "part", "id", "second", "vector"]]

    return rows.mapInPandas(split, "size int, ring int, part long, id long, second long, vector array<double>"), cells


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.trunc(x * 10.0**places + np.copysign(0.5, x)) / 10.0**places


def _least(best, cutoff: float, places: int):
    """What a cosine has to reach to count beside a best score rounded to ``places``."""
    return np.maximum(best, cutoff) - 0.5 * 10.0**-places


def _wanted(own: pd.DataFrame, bound: np.ndarray, cutoff: float, places: int) -> np.ndarray:
    return bound >= _least(own["score"].fillna(-1.0).to_numpy(), cutoff, places)[:, None] - SLACK


def _parts_asked(items: DataFrame, cells: Cells, cutoff: float, places: int) -> int:
    """How many parts all items would ask for in the second turn."""

    def run(batches):
        for batch in batches:
            for size, own, units in _by_size(batch):
                if size in cells.rings:
                    yield pd.DataFrame({"n": [int((_wanted(own, cells.bounds(size, units), cutoff, places) * cells.rings[size]["parts"][None, :]).sum())]})

    return items.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _asks(items: DataFrame, cells: Cells, cutoff: float, first: bool, places: int = PLACES) -> DataFrame:
    """``(size, ring, part, item_id, vector)``: the one part to look at first, or all others whose bound reaches ``score`` and the cutoff."""

    def run(batches):
        for batch in batches:
            for size, own, units in _by_size(batch):
                if size not in cells.rings:
                    continue
                r, bound = cells.rings[size], cells.bounds(size, units)
                best = bound.argmax(axis=1)
                if first:
                    who, which = np.arange(len(own)), best
                    part = np.zeros(len(own), dtype=np.int64)
                else:
                    who, which = np.nonzero(_wanted(own, bound, cutoff, places))
                    many = r["parts"][which]
                    who, which = np.repeat(who, many), np.repeat(which, many)
                    part = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                    new = (part > 0) | (which != best[who])
                    who, which, part = who[new], which[new], part[new]
                for s in range(0, len(who), 10_000):
                    w = who[s : s + 10_000]
                    yield pd.DataFrame({"size": size, "ring": r["ring"][which[s : s + 10_000]].astype(np.int32), "part": part[s : s + 10_000], "item_id": own["item_id"].to_numpy()[w], "vector": list(units[w])})

    return items.mapInPandas(run, "size int, ring int, part long, item_id long, vector array<double>")


FOUND = "item_id long, match_id long, score double, top double"


def _met(asks: DataFrame, parts: DataFrame, other: bool, block: int, places: int = PLACES) -> DataFrame:
    """``(item_id, match_id, score, top)``: the best of each part for each item that asks for it; ``top``: before rounding."""
    key = ["size", "ring", "part"]
    slots = asks.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("long").alias("slots"))
    left = asks.join(slots, key).withColumn("slot", F.pmod(F.xxhash64("item_id"), F.col("slots"))).select(*key, "slot", "item_id", "vector")
    right = parts.join(slots, key).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "id", "second", "vector")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"item_id": [], "match_id": [], "score": [], "top": []}).astype({"item_id": "int64", "match_id": "int64"})
        b = b.sort_values("id")
        ids, second = b["id"].to_numpy(), b["second"].to_numpy()
        items = a["item_id"].to_numpy()
        scores = np.array(a["vector"].tolist()) @ np.array(b["vector"].tolist()).T
        match = np.broadcast_to(ids[None, :], scores.shape)
        if other:  # the item's own row gives way to the second of its equals, if there is one
            own = items[:, None] == ids[None, :]
            match = np.where(own, second[None, :], match)
            scores = np.where(own & (second[None, :] == NONE), -np.inf, scores)
        top = scores.max(axis=1)
        score = _rounded(top, places)
        least = np.where(_rounded(scores, places) == score[:, None], match, np.iinfo(np.int64).max).min(axis=1)
        return pd.DataFrame({"item_id": items, "match_id": least, "score": score, "top": top})

    met = left.groupBy(*key, "slot").cogroup(right.groupBy(*key, "slot")).applyInPandas(run, FOUND)
    return met.where(F.col("score") > float("-inf"))


def _units_packed(rows: DataFrame, columns: list[str], lines: int) -> DataFrame:
    """`packing.packed` of unit vectors, by size; ``columns`` are numbers that go with each."""

    def run(batches):
        for batch in batches:
            for size, own, units in _by_size(batch):
                yield from packing.chunks(size, units, {c: own[c].to_numpy() for c in columns}, lines)

    return rows.mapInPandas(run, packing.schema(columns))


def _every(items: DataFrame, table: DataFrame, cutoff: float, other: bool, places: int) -> DataFrame:
    """``(item_id, match_id, score, top)``: for each item ``(item_id, size, vector, score)`` and block of the whole table the best one
    that reaches the item's score and the cutoff.

    Products are made in single precision; what comes within their error of the score to beat is made again in double.
    """
    left, right = stage.written(items), table
    lines = packing.lines([left, right])
    a = _units_packed(left.withColumnRenamed("item_id", "id").withColumn("score", F.coalesce("score", F.lit(-1.0))), ["id", "score"], lines)
    b = _units_packed(right, ["id", "second"], lines)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"item_id": [], "match_id": [], "score": [], "top": []}).astype({"item_id": "int64", "match_id": "int64"})
        if not len(x) or not len(y):
            return none
        asked, (who, best) = packing.unpacked(x, {"id": np.int64, "score": np.float64})
        there, (ids, second) = packing.unpacked(y, {"id": np.int64, "second": np.int64})
        error = (asked.shape[1] + 4) * 1.2e-7
        best, top, match = best.copy(), np.full(len(who), -np.inf), np.full(len(who), np.iinfo(np.int64).max)
        narrow, others = asked.astype(np.float32), there.astype(np.float32)
        for s in range(0, len(there), TILE):
            tile = others[s : s + TILE].T.copy()
            for r in range(0, len(asked), TILE):
                d = narrow[r : r + TILE] @ tile
                need = (_least(best[r : r + TILE], cutoff, places) - error).astype(np.float32)
                rows = np.nonzero(d.max(axis=1) >= need)[0]
                if not len(rows):
                    continue
                i, j = np.nonzero(d[rows] >= need[rows, None])
                i, j = rows[i] + r, j + s
                m = ids[j]
                if other:  # the item's own row gives way to the second of its equals, if there is one
                    m = np.where(who[i] == m, second[j], m)
                    i, j, m = i[m != NONE], j[m != NONE], m[m != NONE]
                exact = np.einsum("ij,ij->i", asked[i], there[j])
                np.maximum.at(top, i, exact)
                score = _rounded(exact, places)
                order = np.lexsort((m, -score, i))
                i, m, score = i[order], m[order], score[order]
                one = np.r_[True, i[1:] != i[:-1]][: len(i)]
                i, m, score = i[one], m[one], score[one]
                new = (score > best[i]) | (score == best[i]) & (m < match[i])
                best[i[new]], match[i[new]] = score[new], m[new]
        got = match < np.iinfo(np.int64).max
        return pd.DataFrame({"item_id": who[got], "match_id": match[got], "score": best[got], "top": top[got]})

    return packing.grid(a, b, lines, run, FOUND)


def nearest(items: DataFrame, table: DataFrame, cutoff: float, other: bool = False, block: int = BLOCK, places: int = PLACES) -> DataFrame:
    """``(item_id, match_id, score)``: each item's nearest vector of ``table`` by cosine, if it reaches the cutoff.

    Both frames: (id, vector), ids whole numbers, distinct in each frame. ``other``: a row with the item's own id
    doesn't count. Scores are compared to ``places``, of equal ones the least id stands; the cutoff holds for the greatest cosine, to
    nine places. Vectors that are null, have a null, or are of length zero match nothing, and vectors of different sizes don't meet.
    Empty tables give an empty result.
    """
    different = stage.written(_different(_good(table)))
    parts, cells = index(different, block)
    asked = _good(items).select(F.col("id").alias("item_id"), "size", "vector")
    first = stage.written(_met(_asks(asked, cells, cutoff, True, places), parts, other, block, places))
    open_items = asked.join(first.select("item_id", "score"), "item_id", "left")
    if _parts_asked(open_items, cells, cutoff, places) <= ASKS * max(1, asked.count()):
        rest = _met(_asks(open_items, cells, cutoff, False, places), parts, other, block, places)
    else:
        rest = _every(open_items, different, cutoff, other, places)
    best = first.unionByName(rest).groupBy("item_id").agg(F.max(F.struct("score", (-F.col("match_id")).alias("m"))).alias("x"), F.max("top").alias("top"))
    best = best.where(F.round("top", PLACES) >= cutoff)
    return best.select("item_id", (-F.col("x.m")).alias("match_id"), F.col("x.score").alias("score"))


def _different(rows: DataFrame) -> DataFrame:
    """One row for each different vector: its least id, and the second least (NONE: none)."""
    two = rows.withColumn("n", F.row_number().over(Window.partitionBy("size", "vector").orderBy("id"))).where("n <= 2")
    pair = two.groupBy("size", "vector").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    return pair.select("size", "vector", "id", F.when(F.col("last") > F.col("id"), F.col("last")).otherwise(NONE).alias("second"))
