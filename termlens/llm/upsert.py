"""Copy-on-write upsert by key into a folder of sorted Parquet files, without a join.

The folder's files hold ranges of the key. A key's *home* is the last file that begins at or below it, else the first. Base rows
and changes are tagged and put into one union; one group-by the key keeps the base struct and, by ``max_by``, the change that
wins, so that comparing the two tells whether a row differs. Homes with such a row are dirty: their rows are numbered in
key order and cut evenly into as few files as hold them; all other files stay as they are.

What the driver sees is one row for each file (``FILES`` at most) and for each range of keys: the beginnings of the files, how
many rows each home has then, and from these how each is cut and which new file takes its right neighbour's rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termlens.llm import common

#: Starting files at most (one more row each where they would be more).
FILES = 700


def place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at or below ``key``: one look at the heads of blocks, one at a block."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda x: F.lit(x).cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, lambda x: x <= key))
    i = below(longs([b[0] for b in blocks]))
    inner = F.get(F.array(*[longs(b) for b in blocks]), i - 1)
    return F.when(i == 0, F.lit(0)).otherwise((i - 1) * step + below(inner))


def _at(values: list[int], i: Column) -> Column:
    return F.get(F.lit(values).cast("array<bigint>"), i)


def numbered(rows: DataFrame, key: str, name: str = "at") -> DataFrame:
    """``rows`` with their place (from 0) in the order of ``key``, equal keys by the other columns.

    Ranges of the key are numbered on their own and begin where the counts of the ranges before end, so no task sees all rows.
    """
    n = 4 * common.partitions(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]
    part = rows.withColumn("__part", place(F.col(key), sorted(set(cuts or []))))
    sizes = {r["__part"]: r["count"] for r in part.groupBy("__part").count().collect()}
    before = [sum(sizes.get(j, 0) for j in range(i)) for i in range(max(sizes, default=0) + 1)]
    order = Window.partitionBy("__part").orderBy(key, *[c for c in rows.columns if c != key])
    return part.withColumn(name, _at(before, F.col("__part")) + F.row_number().over(order) - 1).drop("__part")


def _files(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_sorted(rows: DataFrame, folder: str, key: str, per_file: int) -> list[tuple[str, int, int]]:
    """Writes ``rows`` in the order of ``key`` as files of ``per_file`` rows (the last: the rest) into a new folder; rows without a key
    are left out. Gives ``(path, first key, rows)`` of each file, in order."""
    spark = rows.sparkSession
    p, fs = _path(spark, folder)
    fs.mkdirs(p)
    names = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    placed = numbered(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), names.alias("row")), "k")
    last = placed.agg(F.max("at")).first()[0]
    if last is not None:
        placed.repartitionById(last // per_file + 1, (F.col("at") / per_file).cast("int")).sortWithinPartitions("at").select("row.*").write.mode("append").parquet(folder)
    return listed(spark, folder, rows.schema, key)


def listed(spark: SparkSession, folder: str, schema: StructType, key: str) -> list[tuple[str, int, int]]:
    """``(path, first key, rows)`` of the files of a folder, by first key."""
    found = _files(spark, folder, schema).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("first"), F.count("*").alias("n"))
    return sorted(((r["path"], r["first"], r["n"]) for r in found.collect()), key=lambda x: (x[1], x[0]))


def cut_plan(homes: list[tuple[bool, int]], most: int) -> tuple[list[int], list[int], list[int], int]:
    """How dirty homes become files. ``homes``: (dirty, rows then) in order; ``most``: rows of a file at most.

    Gives for each home the number of its files, the number of its first file if it stays on its own, and the number of the file
    that its first piece goes to; last, how many numbers there are. Pieces of a home are as few as hold it, at most one row apart,
    the larger first; from left to right, a piece joins its left neighbour (as grown) if that is new too and both have ``most`` rows at most.
    Of one home's pieces no two fit into a file, so only a home's first piece can join.
    """
    pieces, base, target, used = [], [], [], 0
    left: tuple[int, int] | None = None  # number and rows of the remaining file on the left, if it is new
    for dirty, n in homes:
        k = -(-n // most) if dirty else 0
        pieces.append(k)
        base.append(used)
        target.append(used)
        if not dirty:
            left = None
        elif k:
            first, last = -(-n // k), n // k
            if left and left[1] + first <= most:
                target[-1] = left[0]
                left = (left[0], left[1] + first) if k == 1 else (used + k - 1, last)
            else:
                left = (used + k - 1, last)
            used += k
    return pieces, base, target, used


def upsert(spark: SparkSession, folder: str, schema: StructType, changes: DataFrame, key: str, order: list[str], new: Callable[[Column, Column, Column], Column], per_file: int, is_open: Callable[[int], bool] = lambda first: True) -> tuple[int, int]:
    """Applies ``changes`` to the files of ``folder`` (as `write_sorted` writes them); gives how many files went and came.

    Of a key's changes the one with the highest ``order`` columns wins (nulls lowest; of equal ones one by the hash of the rest).
    ``new(base, change, first)`` makes the new row's struct, or null for none, from the base struct (null where the key is
    absent), the change struct and the first key of the home. Homes whose first key isn't ``is_open`` are left out before anything
    moves. Changes without a key, and all changes of a folder without files, are left out; extra columns of changes are part of
    the change struct, so their names can't clash. Keys are whole numbers and unique in the base; of base rows with one
    key the greatest stays, and its home is dirty. The files come before the old ones go: a run that ends in between leaves
    both, so a folder is upserted by one run at a time.
    """
    old = listed(spark, folder, schema, key)
    if not old:
        return 0, 0
    starts = [first for _, first, _ in old]
    opened = [int(bool(is_open(first))) for first in starts]
    home = F.greatest(place(F.col("k"), starts) - 1, F.lit(0))
    names = [F.col(f"`{c}`") for c in schema.names]
    base = _files(spark, folder, schema).select(F.col(key).alias("k"), F.struct(*names).alias("base"))
    rest = [c for c in changes.columns if c not in order]
    change = changes.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("change"), F.struct(*order, F.xxhash64(*[F.col(f"`{c}`") for c in rest])).alias("rank"))
    both = base.unionByName(change, allowMissingColumns=True).where(_at(opened, home) == 1)
    one = both.groupBy("k").agg(F.max("base").alias("base"), F.count("base").alias("n_base"), F.max_by("change", "rank").alias("change"))
    row = F.when(F.col("change").isNull(), F.col("base")).otherwise(new(F.col("base"), F.col("change"), _at(starts, home)))
    merged = one.select("k", home.alias("home"), "base", "n_base", row.alias("row"))
    merged = merged.select("k", "home", "row", ((F.col("n_base") > 1) | ~F.col("row").eqNullSafe(F.col("base"))).alias("differs"))
    merged = common.written(merged.where("row is not null or differs"))

    found = {r["home"]: (r["dirty"], r["n"]) for r in merged.groupBy("home").agg(F.bool_or("differs").alias("dirty"), F.count("row").alias("n")).collect()}
    homes = [found.get(h, (False, 0)) for h in range(len(starts))]
    pieces, first_file, target, used = cut_plan(homes, per_file)
    n = [n if dirty else 0 for dirty, n in homes]
    if used:
        dirty_homes = F.get(F.lit([int(d) for d, _ in homes]), F.col("home")) == 1
        rows = numbered(merged.where(dirty_homes & F.col("row").isNotNull()).select("k", "home", "row"), "k")
        within = F.col("at") - _at([sum(n[:h]) for h in range(len(n))], F.col("home"))
        small = _at([x // max(1, k) for x, k in zip(n, pieces)], F.col("home"))  # rows of a piece
        larger = _at([x % max(1, k) for x, k in zip(n, pieces)], F.col("home"))  # pieces with one row more, the first ones
        front = larger * (small + 1)
        piece = F.when(F.col("within") < front, (F.col("within") / (small + 1)).cast("long")).otherwise(larger + ((F.col("within") - front) / F.greatest(small, F.lit(1))).cast("long"))
        rows = rows.withColumn("within", within).withColumn("piece", piece)
        file = F.when(F.col("piece") == 0, _at(target, F.col("home"))).otherwise(_at(first_file, F.col("home")) + F.col("piece"))
        rows.repartitionById(used, file.cast("int")).sortWithinPartitions("at").select("row.*").write.mode("append").parquet(folder)
    gone = [path for (path, _, _), (dirty, _) in zip(old, homes) if dirty]
    for path in gone:  # at most FILES
        p, fs = _path(spark, path)
        fs.delete(p, False)
    return len(gone), len(set(target[h] for h in range(len(n)) if pieces[h])) + sum(k - 1 for k in pieces if k)


_OUT = "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, path string"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each path of rows in the order of path and place; only sums and a running hash are kept."""
    path, held = None, None
    for batch in batches:
        out = []
        for p, own in batch.groupby("path", sort=False):
            if p != path:
                if held:
                    out.append((*held[:4], held[4].hexdigest(), path))
                path, held = p, [int(own["id"].iloc[0]), 0, 0, 0, hashlib.sha256()]
            held[4].update(("," * bool(held[1]) + ",".join(map(str, own["id"]))).encode())
            held[1:4] = held[1] + len(own), held[2] + int(own["cents"].sum()), held[3] + int(own["crc"].sum())
        yield pd.DataFrame(out, columns=["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "path"])
    if held:
        yield pd.DataFrame([(*held[:4], held[4].hexdigest(), path)], columns=["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "path"])


def digests(spark: SparkSession, folder: str, schema: StructType, key: str, cents: Column, crc: Column) -> DataFrame:
    """A row for each file of the folder: first key, rows, sums of two columns, the hash of its keys in the file's order, its path."""
    place_in_file = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")]
    rows = _files(spark, folder, schema).select(*place_in_file, F.col(key).cast("long").alias("id"), cents.alias("cents"), crc.alias("crc"))
    rows = rows.repartition(4 * common.partitions(spark), "path").sortWithinPartitions("path", "at")
    return rows.mapInPandas(_digests, _OUT)


def _crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def client_row(base: Column, change: Column, first: Column, names: list[str], types: dict[str, str]) -> Column:
    """The new row of a client: none if the change deletes, else the base row (or one of nulls) with the change's four fields."""
    h = _crc(first) % 12
    deletes = F.coalesce(change["op"] == "D", F.lit(False)) | F.coalesce(_crc(change["change_id"]) % 8 < h, F.lit(False))
    value = lambda c: change[c] if c in ("client_id", "source", "segment", "city", "balance") else base[c]
    return F.when(~deletes, F.struct(*[value(c).cast(types[c]).alias(c) for c in names]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_upsert``: `client_changes` into files of a part of ``clients``; a row for each file that is there then.

    A new folder under the checkpoint folder at every call; it stays. Clients and changes without an id are left out.
    """
    clients = common.read(spark, sf_dir, "clients")
    per_file = 1 + clients.count() // FILES
    folder = f"{common._folder(spark)}/clients-{uuid.uuid4().hex}"
    schema, names = clients.schema, clients.columns
    types = {f.name: f.dataType.simpleString() for f in schema}
    old = write_sorted(clients.where(_crc(F.col("client_id")) % 7 > 3), folder, "client_id", per_file)
    upsert(spark, folder, schema, common.read(spark, sf_dir, "client_changes"), "client_id", ["seq", "change_id"], lambda b, c, f: client_row(b, c, f, names, types), per_file, lambda first: zlib.crc32(str(first).encode()) % 12 <= 7)
    cents = F.coalesce(F.floor(F.col("balance") * 100 + 0.5), F.lit(0)).cast("long")
    crc = _crc(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")]))
    out = digests(spark, folder, schema, "client_id", cents, crc)
    was = F.lit([path for path, _, _ in old]).cast("array<string>")
    names_there = spark.read.parquet(folder).columns if old else names
    return out.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(names_there)).alias("columns"), "path", (~F.array_contains(was, F.col("path"))).alias("rewritten"))
