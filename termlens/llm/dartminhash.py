"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

A text is a weighted set: its shingles of five words, each weighing as often as it occurs; likeness is the
weighted Jaccard index (sum of least weights over sum of greatest). For the signature, each element throws
darts: a Poisson process, fixed by hashes of the element, over the region (0, weight] x (0, rank bound). Each
dart has a coordinate by hash; a coordinate keeps its dart of least rank. The chance that two sets keep the
same dart is their likeness. Only about ``k (ln k + 5)`` darts are made for a text, however long it is; where
a coordinate stays empty the rank bound doubles.

Joining: ``BANDS`` bands of ``ROWS`` coordinates make bucket keys. A pair of likeness 0.8 shares no bucket with
probability (1 - 0.8^5)^25 = 5e-5. Equal texts are one node from the start. No bucket is expanded into pairs:

1. each node is checked against one other, the least node of any of its buckets, exactly, on the texts;
2. components follow; a bucket whose nodes are one component can join nothing more and is done;
3. the nodes of the buckets that are left meet in blocks of ``SIGNED`` by ``SIGNED``; within a task the signatures
   of nodes of different components are compared; nodes without a pair that may reach the threshold (estimate
   above ``NEAR_ESTIMATE``, over four standard errors below it) drop out;
4. the others meet again with their texts, in blocks of ``BLOCK``; a task checks pairs exactly, likely ones first, and leaves out pairs
   that are joined already. Only the edges that join components come out, never the pairs.

So no cap applies, and a group of n near copies costs about n checks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common
from termlens.llm.hashing import BASE, U, codes, letters, mix

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: Lowest share of equal coordinates of a pair that is still checked.
NEAR_ESTIMATE = 0.65
#: Nodes of a bucket that meet within a task: with their signatures, and with their texts.
SIGNED, BLOCK = 4096, 256
#: Edges for each file of labels.
LABELS = 200_000
DARTS = COORDINATES * (math.log(COORDINATES) + 5)
_CELL, _DART, _COPY = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
_TO_UNIT = 2.0**-53


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each maximal run of other than white space (space and controls from tab to return)."""
    c = codes(text)
    solid = ~((c == 32) | ((c >= 9) & (c <= 13)))
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, U)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    return mix(np.add.reduceat(letters(c[at]) * _powers(int(length.max()))[place], first) + length.astype(U))


_TABLE = [np.cumprod(np.full(64, BASE, U))]


def _powers(n: int) -> np.ndarray:
    while len(_TABLE[0]) < n:
        _TABLE[0] = np.concatenate([_TABLE[0], _TABLE[0] * _TABLE[0][-1]])
    return _TABLE[0]


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted hashes) and how often each occurs; fewer words than ``words`` are one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0, np.int64)
    size = min(words, len(w))
    n = len(w) - size + 1
    h = w[:n].copy()
    for i in range(1, size):
        h *= BASE
        h += w[i : i + n]
    return np.unique(mix(h + U(size)), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common_, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 1.0


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers above 0, up to 1."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * _TO_UNIT


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES, darts: float | None = None) -> np.ndarray:
    """``k`` 32-bit names of the darts kept; weights are positive numbers (a part of a unit thins its darts)."""
    units = np.ceil(weights).astype(np.int64)
    copies = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
    x = mix(np.repeat(elements, units) + copies.astype(U) * _COPY)
    share = np.minimum(1.0, np.repeat(weights, units) - copies)
    whole = bool((share == 1.0).all())
    bound = (darts or k * (math.log(k) + 5)) / float(weights.sum())
    while True:
        cells = max(1, math.ceil(bound))
        cell = mix(x[:, None] + np.arange(1, cells + 1, dtype=U)[None, :] * _CELL).ravel()
        base = np.tile(np.arange(cells, dtype=np.float64), len(x))
        part = None if whole else np.repeat(share, cells)
        ranks, names = [], []
        # The darts of a cell arrive one after the other, with exponential gaps; only those before its end count.
        place = np.zeros(len(cell))
        step = 0
        while len(cell):
            step += 1
            h = mix(cell + U(step * int(_DART) % 2**64))
            end = np.minimum(1.0, bound - base)
            if step == 1 and cells == 1:  # most elements of a long text throw no dart: no logarithm for them
                near = _unit(h) >= math.exp(-min(1.0, bound)) * (1 - 1e-12)
                cell, base, place, h, end = cell[near], base[near], place[near], h[near], end[near]
                part = None if part is None else part[near]
            place = place - np.log(_unit(h))
            live = place < end
            cell, base, place, h = cell[live], base[live], place[live], h[live]
            part = None if part is None else part[live]
            name = mix(h ^ BASE)
            if part is not None:
                inside = _unit(mix(name ^ _COPY)) <= part
                ranks.append((base + place)[inside])
                names.append(name[inside])
            else:
                ranks.append(base + place)
                names.append(name)
        rank, name = np.concatenate(ranks), np.concatenate(names)
        coordinate = ((name >> U(32)) * U(k)) >> U(32)
        order = np.argsort(-rank, kind="stable")
        out, full = np.zeros(k, np.uint32), np.zeros(k, bool)
        out[coordinate[order]] = name[order].astype(np.uint32)  # the least rank is written last
        full[coordinate] = True
        if full.all():
            return out
        bound *= 2


_BAND_SEED = mix(np.arange(1, BANDS + 1, dtype=U) * _CELL)


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(U)
    key = _BAND_SEED.copy()
    for i in range(ROWS):
        key = mix(key * BASE + rows[:, i])
    return key.view(np.int64)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes, sigs, keys = [], [], []
        for text in batch["text"]:
            e, c = shingles(text)
            sizes.append(int(c.sum()))
            sig = signature(e, c.astype(np.float64)) if len(e) else None
            sigs.append(None if sig is None else sig.tobytes())
            keys.append(None if sig is None else bands(sig))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "node": batch["node"], "n": sizes, "sig": sigs, "bands": keys})


def node_of(text) -> F.Column:
    """A text's 64-bit hash: equal texts are one node."""
    return F.xxhash64(common.text_or_empty(text))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of the component, for every node of ``edges`` (a, b).

    Each turn takes the least label among neighbours, then the label's own label (so paths halve); it ends when
    nothing changes.
    """
    both = common.written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    parts = 1 + common.count(both) // LABELS
    turn = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), parts=parts)
    while True:
        labels = turn.select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("step"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("step"), F.col("label").alias("up"))
        turn = common.written(step.join(up, "step").select("node", F.least("step", "up").alias("label"), "was"), before=turn.path, parts=parts)
        if turn.where("label < was").isEmpty():
            return turn.select("node", "label")


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that reach the threshold. A run of pairs with one leader parses it once."""
    for batch in batches:
        last, parsed, keep = None, None, []
        for text_a, b, text_b in zip(batch["text_a"], batch["b"], batch["text_b"]):
            if last != b:
                last, parsed = b, shingles(text_b)
            keep.append(weighted_jaccard(shingles(text_a), parsed) >= THRESHOLD)
        yield batch.loc[keep, ["a", "b"]]


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold exactly; written."""
    pairs = common.cut(pairs)
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.select("node", "text").join(involved, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    texts = common.cut(texts)
    rows = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return common.cut(rows.select("a", "text_a", "b", "text_b").mapInPandas(_check, "a long, b long"))


def _runs(batches: Iterator[pd.DataFrame], columns: tuple[str, ...], work) -> Iterator[pd.DataFrame]:
    """``work`` on each run of equal (key, i, j) in sorted batches; a run is at most two blocks."""
    pending: list[tuple] = []
    at = None
    for batch in batches:
        for key, i, j, *row in zip(*(batch[c] for c in ("key", "i", "j", *columns))):
            if (key, i, j) != at:
                if len(pending) > 1:
                    yield work(at, pending)
                pending, at = [], (key, i, j)
            pending.append(tuple(row))
    if len(pending) > 1:
        yield work(at, pending)


def _candidates(at: tuple, rows: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From rows (node, comp, n, block, band, sig, ...) of a run: for each row, the later rows of the other
    block that may be near and of another component, and their estimates. A pair that shares several buckets
    belongs to its first band's."""
    _, i, j = at
    comp, n, block = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(len(rows), COORDINATES)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left:
        y = right[right > x] if i == j else right
        y = y[(comp[y] != comp[x]) & (np.minimum(n[y], n[x]) >= THRESHOLD * np.maximum(n[y], n[x]))]
        if not len(y):
            continue
        same = sig[y] == sig[x]
        share = same.mean(axis=1)
        first = same.reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1)
        keep = (share >= NEAR_ESTIMATE) & (first == rows[x][4])
        if keep.any():
            yield int(x), y[keep], share[keep]


def _needed(at: tuple, rows: list[tuple]) -> pd.DataFrame:
    """The nodes of a run that have a candidate."""
    some: set[int] = set()
    for x, y, _ in _candidates(at, rows):
        some.add(x)
        some.update(y.tolist())
    return pd.DataFrame({"key": np.full(len(some), at[0], np.int64), "node": np.array([rows[k][0] for k in sorted(some)], np.int64)})


def _joined(at: tuple, rows: list[tuple]) -> pd.DataFrame:
    """Edges of a run, checked on the texts; pairs that edges so far have joined aren't checked."""
    parsed: dict[int, tuple] = {}
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    pairs = sorted(((-s, x, int(k)) for x, y, share in _candidates(at, rows) for k, s in zip(y, share)), key=lambda p: p[0])
    out = []
    for _, x, y in pairs:
        a, b = root(rows[x][1]), root(rows[y][1])
        if a == b:
            continue
        for k in (x, y):
            if k not in parsed:
                parsed[k] = shingles(rows[k][6])
        if weighted_jaccard(parsed[x], parsed[y]) >= THRESHOLD:
            parent[a] = b
            out.append((max(rows[x][0], rows[y][0]), min(rows[x][0], rows[y][0])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, node, ...) of buckets, each in every pair of blocks of its bucket that holds its own, sorted."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    return rows.repartition(common.partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def _near(n: str, m: str) -> F.Column:
    return F.least(n, m) >= THRESHOLD * F.greatest(n, m)


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Checked edges (a, b) whose components are those of all near pairs that share a bucket.

    ``nodes``: (node, n, sig, bands), one row for each text; ``docs``: (node, text).
    """
    own = nodes.where("bands is not null").select("node", "n", F.posexplode("bands").alias("band", "key"))
    leaders = own.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).where("lead.node < last")
    members = common.cut(own.join(leaders.drop("last"), "key").select("key", "band", "node", "n", "lead"))
    stars = members.where(F.col("node") > F.col("lead.node")).where(_near("n", "lead.n")).groupBy(F.col("node").alias("a")).agg(F.min("lead.node").alias("b"))
    edges = _verified(stars, docs)
    placed = members.drop("lead").join(components(edges), "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    placed = common.cut(placed)
    left = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    rest = placed.join(left, "key", "left_semi").join(nodes.select("node", "sig"), "node")
    columns = ("node", "comp", "n", "block", "band", "sig")
    needed = common.cut(_dealt(rest, SIGNED).mapInPandas(lambda it: _runs(it, columns, _needed), "key long, node long").distinct())
    texts = docs.join(needed.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    rest = placed.join(needed, ["key", "node"]).join(nodes.select("node", "sig"), "node").join(texts, "node")
    more = common.cut(_dealt(rest, BLOCK).mapInPandas(lambda it: _runs(it, (*columns, "text"), _joined), "a long, b long"))
    return edges.union(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, node, class_id, class_size, copies)`` for each row.

    ``class_id`` is the least id of the row's class (rows linked by likeness of 0.8 or more), ``class_size`` its
    rows, ``copies`` the rows with this very text. Null texts count as empty; texts without a word are alike
    only if equal. A class whose ids are all null has a null ``class_id``. Repeated rows are copies. Texts with
    equal 64-bit hashes count as equal (for n texts one such pair is expected in n^2 / 2^65). Texts are read whole,
    however long; an empty table gives an empty result; other columns aren't looked at, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text")).withColumn("node", F.xxhash64("text"))
    each = common.cut(rows.mapInPandas(_sketch, "doc_id long, node long, n long, sig binary, bands array<long>"))
    nodes = common.cut(each.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.any_value(F.struct("n", "sig", "bands")).alias("s")).select("node", "least", "copies", "s.*"))
    labels = components(links(nodes, rows))
    placed = nodes.select("node", "least", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = placed.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    known = placed.join(classes, "label").select("node", "class_id", "class_size", "copies")
    return each.select(F.col("doc_id").alias(id_col), "node").join(known, "node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_dartminhash``: the near-duplicate class of every row of ``documents``."""
    return near_duplicates(common.read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row left of each class: that of the least doc_id (null ids last).

    Nulls, empty, long and repeated texts are as in `near_duplicates`; of rows with equal id and text one stays. The other
    columns come back as they are; an empty table gives an empty one.
    """
    found = near_duplicates(docs)
    # The least id may have several texts (repeated ids): the least node of them stays.
    first = found.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("lone")).agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.col("node"))).alias("__near_node"))
    first = first.select(F.col("class_id").alias("__near_id"), "__near_node")
    rows = docs.withColumn("__near_node", node_of("text"))
    out = rows.join(first, (rows["__near_node"] == first["__near_node"]) & rows["doc_id"].cast("long").eqNullSafe(first["__near_id"]), "left_semi")
    if not found.groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["__near_node"])
    return out.select(*docs.columns)
