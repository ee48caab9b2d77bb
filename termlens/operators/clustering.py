"""Balanced samples, k-means with a silhouette choice of k, and role labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlens.operators import packing
from termlens.sources import stage

# The role words that sort postings into categories, in order of precedence.
CATEGORIES = ("software engineer", "data scientist", "data engineer", "machine learning", "cybersecurity", "information security", "devops", "cloud engineer", "database administrator", "systems administrator", "web developer", "network engineer", "business intelligence")
# Names of the clusters.
LABELS = {0: "Cybersecurity / Information Security", 1: "Data Science / Data Engineering", 2: "Software / Web Development", 3: "Systems Administration", 4: "Machine Learning / AI", 5: "DevOps / Cloud Engineering", 6: "Business Intelligence", 7: "Network Engineering", 8: "Mixed (weak cluster -- multiple roles blended together)", 9: "Near-duplicate postings (data quality quirk, not a real role group)", 10: "Database Administration"}
PER_CATEGORY, MIN_CHARS, SEED = 150, 150, 42
#: Rows of a product of matrices where all points meet.
BLOCK = 1024
#: Different vectors among which k-means begins.
START_ROWS = 4096


def long_enough(rows: DataFrame, column: str = "description", least: int = MIN_CHARS) -> DataFrame:
    """Rows whose text has ``least`` characters or more; null texts go."""
    return rows.where(F.length(column) >= least)


def capacity_sample(rows: DataFrame, title: str, order: str, categories=CATEGORIES, capacity: int = PER_CATEGORY * 3) -> DataFrame:
    """``rows`` with ``category``: each row, in order, goes to the first category that its title names and that isn't full.

    A category that isn't full has had fewer than ``capacity`` rows, and each of those before it ``capacity`` at most. So a row goes to
    the i-th category only if it is among the first ``i * capacity`` rows that name it. These rows, in one pass a top-k for each category, are all
    that the row-by-row rule needs to see, and their number depends on categories and capacity alone: one task plays them through. ``order`` is a
    column without repeats; null titles name nothing.
    """
    named = [F.when(F.contains(F.lower(title), F.lit(c)), F.lit(i)) for i, c in enumerate(categories)]
    hits = rows.select(order, F.explode(F.filter(F.array(*named), lambda i: i.isNotNull())).alias("__i"))
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy("__i").orderBy(order))).where(F.col("__n") <= capacity * len(categories))
    first = first.where(F.col("__n") <= (F.col("__i") + 1) * capacity).groupBy(order).agg(F.array_sort(F.collect_list("__i")).alias("__may"))
    kind = rows.schema[order].dataType.simpleString()

    def play(batches):
        taken = [0] * len(categories)
        for batch in batches:
            out = []
            for key, may in zip(batch["k"], batch["may"]):
                i = next((i for i in may if taken[i] < capacity), None)
                if i is not None:
                    taken[i] += 1
                    out.append((key, categories[i]))
            yield pd.DataFrame(out, columns=["k", "category"])

    bounded = first.select(F.col(order).alias("k"), F.col("__may").alias("may")).repartition(1).sortWithinPartitions("k")  # capacity * n * (n + 1) / 2 rows at most
    placed = bounded.mapInPandas(play, f"k {kind}, category string").withColumnRenamed("k", order)
    return rows.join(placed, order).select(*rows.columns, "category")


def shuffled_take(rows: DataFrame, by: str, key: str, n: int = PER_CATEGORY, seed: int = SEED) -> DataFrame:
    """``n`` rows of each group in an order by hash."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))).where(F.col("__n") <= n).drop("__n")


def silhouettes(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(place, silhouette)``: mean Euclidean silhouette of ``(id, vector, clusters)`` for each place of the array of cluster numbers.

    Every two points meet once, whatever the number of clusterings, on a grid of packed blocks (`packing`), by products of matrices of
    ``block`` rows. What leaves a task is a matrix of sums, ``block`` points by all clusters, so neither pairs nor points are rows. The
    driver sees the clusters' sizes. Single points count as 0. Ids are distinct; vectors that are null, have a null or no numbers, and
    points without clusters are left out. All vectors have one length, all points as many clusters.
    """
    good = points.where("id is not null and size(clusters) > 0 and not exists(clusters, x -> x is null) and size(vector) > 0 and not exists(vector, x -> x is null)")
    good = stage.written(good.select(F.monotonically_increasing_id().alias("id"), F.size("vector").alias("size"), F.col("vector").cast("array<double>").alias("vector"), F.col("clusters").cast("array<bigint>").alias("clusters")))
    found = good.select(F.posexplode("clusters").alias("place", "cluster")).groupBy("place", "cluster").agg(F.count("*").alias("n")).orderBy("place", "cluster").toPandas()  # a row a cluster
    if not len(found):
        return points.sparkSession.createDataFrame([], "place int, silhouette double")
    names = [own["cluster"].to_numpy() for _, own in found.groupby("place")]
    starts = np.cumsum([0] + [len(c) for c in names])
    sizes = found["n"].to_numpy(dtype=float)
    width = len(sizes)
    lines = packing.lines([good], 2 * width)

    def pack(batches):
        for batch in batches:
            if len(batch):
                clusters = np.array(batch["clusters"].tolist(), dtype=np.int64)
                columns = np.stack([starts[p] + np.searchsorted(c, clusters[:, p]) for p, c in enumerate(names)], axis=1)
                yield from packing.chunks(int(batch["size"].iloc[0]), _matrix(batch), {"id": batch["id"].to_numpy(), "columns": columns}, lines)

    def ordered(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, (ids, columns) = packing.unpacked(blocks, {"id": np.int64, "columns": np.int64})
        order = np.argsort(ids)
        return x[order], columns.reshape(len(ids), -1)[order]

    def member(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(columns), width))
        out[np.arange(len(columns))[:, None], columns] = 1.0
        return out

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            _, i, j = key
            (x, mine), (y, theirs) = ordered(a), ordered(b)
            across = [0.0] * -(-len(y) // block)
            for r in range(0, len(x), block):
                own, total = member(mine[r : r + block]), 0.0
                for t in range(len(across)):
                    s = t * block
                    d = np.sqrt(_squares(x[r : r + block], y[s : s + block]))
                    if i == j and r == s:
                        np.fill_diagonal(d, 0.0)
                    total = total + d @ member(theirs[s : s + block])
                    if i != j:
                        across[t] = across[t] + d.T @ own
                out.append((i, r // block, j, total.tobytes(), mine[r : r + block].tobytes() if i == j else None))
            if i != j:
                for t in range(len(across)):
                    across[t] = across[t].tobytes()
                    out.append((j, t, i, across[t], None))
        return pd.DataFrame(out, columns=["line", "tile", "by", "total", "own"])

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        for x in rows.sort_values("by")["total"]:
            total = total + np.frombuffer(x).reshape(-1, width)
        own = np.frombuffer(next(x for x in rows["own"] if x is not None), dtype=np.int64).reshape(len(total), -1)
        at, out = np.arange(len(total)), []
        for p, (start, end) in enumerate(zip(starts, starts[1:])):
            n = sizes[own[:, p]]
            inner = np.where(n > 1, total[at, own[:, p]] / np.maximum(n - 1, 1), np.nan)
            outer = total[:, start:end] / sizes[start:end]
            outer[at, own[:, p] - start] = np.inf
            outer = outer.min(axis=1)
            good = np.isfinite(outer) & (n > 1)
            wide = np.maximum(inner, outer)
            s = np.where(good & (wide > 0), (np.where(good, outer, 0.0) - inner) / np.where(wide > 0, wide, 1.0), 0.0)
            out.append((p, float(s.sum()), len(s)))
        return pd.DataFrame(out, columns=["place", "s", "n"])

    blocks = good.mapInPandas(pack, packing.schema(["id", "columns"]))
    sums = packing.grid(blocks, blocks, lines, run, "line int, tile int, by int, total binary, own binary", half=True)
    each = sums.groupBy("line", "tile").applyInPandas(score, "place int, s double, n long")
    return each.groupBy("place").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def silhouette(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row ``(silhouette)``: that of ``(id, vector, cluster)`` (see `silhouettes`); null without points."""
    return silhouettes(points.where("cluster is not null").select("id", "vector", F.array("cluster").alias("clusters")), block).agg(F.max("silhouette").alias("silhouette"))


def silhouette_blocks(points: np.ndarray, labels: np.ndarray, block: int = 512) -> float:
    """The same in blocks of a matrix, for a sample that is on one machine."""
    groups = np.unique(labels)
    member = (labels[:, None] == groups[None, :]).astype(float)
    size = member.sum(axis=0)
    square = (points * points).sum(axis=1)
    out = []
    for s in range(0, len(points), block):
        x = points[s : s + block]
        d = np.sqrt(np.maximum(0, square[s : s + block, None] + square[None, :] - 2 * x @ points.T))
        d[np.arange(len(x)), np.arange(s, s + len(x))] = 0.0
        total = d @ member
        own = member[s : s + block].astype(bool)
        n_own = size[None, :].repeat(len(x), 0)[own]
        inner = np.where(n_own > 1, total[own] / np.maximum(1, n_own - 1), np.nan)
        outer = np.where(own, np.inf, total / size[None, :]).min(axis=1)
        out.append(np.where(np.isnan(inner), 0.0, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300)))
    return float(np.concatenate(out).mean())


def kmeans(points: DataFrame, k: int, seeds=(SEED,)) -> DataFrame:
    """``(id, vector, cluster)`` of the run with the least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    models = [KMeans(k=k, seed=s, maxIter=50).fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("id", "vector", F.col("prediction").alias("cluster"))


def spread_starts(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the points, each drawn by its squared distance to those before."""
    chosen = [int(rng.integers(len(points)))]
    d = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = d.sum()
        chosen.append(int(rng.choice(len(points), p=d / total)) if total > 0 else int(rng.integers(len(points))))
        d = np.minimum(d, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["vector"].tolist(), dtype=float)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)[None, :] - 2 * x @ centers.T)


def _pass(points: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass over the points for all models: sums and counts of each model's clusters, and its cost.

    A task sends a row for each cluster of each model, however many points it has seen.
    """
    sizes = [len(m) for m in models]
    ends = np.cumsum(sizes)
    dim = models[0].shape[1]
    sent = points.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        stacked = np.concatenate(sent.value)
        sums, seen, cost = np.zeros((len(stacked), dim)), np.zeros(len(stacked)), np.zeros(len(stacked))
        for x in (m[s : s + BLOCK] for batch in batches if len(batch) for m in (_matrix(batch),) for s in range(0, len(m), BLOCK)):
            d = _squares(x, stacked)
            member = np.zeros_like(d)
            for end, k in zip(ends, sizes):
                own = d[:, end - k : end].argmin(axis=1)
                member[np.arange(len(x)), end - k + own] = 1
            sums += member.T @ x
            seen += member.sum(axis=0)
            cost += (member * d).sum(axis=0)
        yield pd.DataFrame({"slot": np.arange(len(stacked), dtype=np.int32), "n": seen, "cost": cost, "sums": list(sums)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slot", "n", "cost"])
        slots, place = np.unique(rows["slot"], return_inverse=True)
        total = np.zeros((len(slots), dim + 2))
        np.add.at(total, place, np.column_stack([rows["n"], rows["cost"], np.array(rows["sums"].tolist())]))
        return pd.DataFrame({"slot": slots, "n": total[:, 0], "cost": total[:, 1], "sums": list(total[:, 2:])})

    kind = "slot int, n double, cost double, sums array<double>"
    found = points.select("vector").mapInPandas(run, kind).groupBy((F.col("slot") / 64).cast("int")).applyInPandas(add, kind).orderBy("slot").toPandas()  # one row a cluster
    sums, n, cost = np.array(found["sums"].tolist()), found["n"].to_numpy(), found["cost"].to_numpy()
    return [(sums[e - k : e], n[e - k : e], float(cost[e - k : e].sum())) for e, k in zip(ends, sizes)]


def lloyd(points: DataFrame, ks: list[int], starts: int = 10, seed: int = SEED, turns: int = 50) -> dict[int, tuple[np.ndarray, float]]:
    """For each k the centers and the cost of the best of ``starts`` runs of k-means on ``(id, vector)``.

    All runs of all k move together: each turn is one pass over the points, for the runs that still move, so there are ``turns`` passes
    and one more at most, whatever the number of runs. Runs begin at points of a sample of about ``START_ROWS`` different vectors,
    spread by distance; a cluster without points keeps its center; a run ends when its centers move by less than 1e-4 of the
    points' mean variance. With fewer different vectors than k, centers repeat.
    """
    different = points.select("vector").distinct()
    n = different.count()
    sample = _matrix(different.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < F.lit((1 << 30) * START_ROWS // max(n, START_ROWS))).toPandas())  # START_ROWS in expectation
    if not len(sample):
        return {}
    sample = sample[np.lexsort(sample.T)]
    least = 1e-4 * float(sample.var(axis=0).mean())
    runs = [[k, spread_starts(sample, k, np.random.default_rng([seed, k, r])), True] for k in ks for r in range(starts)]
    for _ in range(turns):
        moving = [r for r in runs if r[2]]
        if not moving:
            break
        for r, (sums, n, _) in zip(moving, _pass(points, [r[1] for r in moving])):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], r[1])
            r[2] = float(((new - r[1]) ** 2).sum()) > least
            r[1] = new
    best: dict[int, tuple[np.ndarray, float]] = {}
    for (k, centers, _), (_, _, cost) in zip(runs, _pass(points, [r[1] for r in runs])):
        if k not in best or cost < best[k][1]:
            best[k] = (centers, cost)
    return best


def assigned(points: DataFrame, models: list[np.ndarray]) -> DataFrame:
    """``(id, vector, clusters)``: the nearest center of each model, of equally near ones the first."""
    sent = points.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), dtype=float)
        return pd.Series(list(np.stack([_squares(x, m).argmin(axis=1) for m in sent.value], axis=1).astype(np.int32)))

    return points.select("id", "vector", nearest("vector").alias("clusters"))


def pick_k(points: DataFrame, ks: range | list[int] = range(6, 21), starts: int = 10, seed: int = SEED) -> tuple[int, float, DataFrame] | None:
    """The k with the best silhouette of all points (the least of equals), its silhouette and clusters; none without points.

    Points are ``(id, vector)``; vectors that are null, have a null or no numbers are left out; all have one length. Of each k's
    ``starts`` runs the cheapest counts. One pass deals the points to all k, one meeting of all points gives all silhouettes.
    """
    ks = sorted(ks)
    good = points.where("id is not null and size(vector) > 0 and not exists(vector, x -> x is null)").select("id", F.col("vector").cast("array<double>").alias("vector"))
    best = lloyd(good, ks, starts, seed)
    if not best:
        return None
    found = assigned(good, [best[k][0] for k in ks])
    scores = {r["place"]: r["silhouette"] for r in silhouettes(found).collect()}
    place = max(range(len(ks)), key=lambda i: (scores[i], -i))
    return ks[place], scores[place], found.select("id", "vector", F.get("clusters", F.lit(place)).alias("cluster"))


def role_labels(cluster_ids: DataFrame, labels: dict[int, str] = LABELS) -> DataFrame:
    """``(cluster_id, role_label)``: the given name, else ``Cluster n``."""
    names = cluster_ids.sparkSession.createDataFrame(list(labels.items()), "cluster_id long, __label string")
    return cluster_ids.distinct().join(names, "cluster_id", "left").select("cluster_id", F.coalesce("__label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("role_label"))


def members_sample(points: DataFrame, n: int = 8, seed: int = SEED) -> DataFrame:
    """A few members of each cluster, for a look."""
    return shuffled_take(points, "cluster", "id", n, seed)


def top_share(score: Column) -> Column:
    return F.least(score, F.lit(1.0)) * 100
