"""The copy-on-write upsert against a plain version in lists, its cutting rule against files one by one, and odd rows."""

import hashlib
import math
import random
import uuid
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from termlens.llm import common, upsert

NAMES = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def crc(x):
    return zlib.crc32(str(x).encode())


def cut(rows, most):
    """As few lists of at most ``most`` rows, evenly, the larger first."""
    k = -(-len(rows) // most)
    out, at = [], 0
    for i in range(k):
        size = len(rows) // k + (i < len(rows) % k)
        out.append(rows[at : at + size])
        at += size
    return out


def plain(clients, changes, most):
    start = sorted((r for r in clients if crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [start[i : i + most] for i in range(0, len(start), most)]
    firsts = [f[0]["client_id"] for f in files]
    new = [{r["client_id"]: r for r in f} for f in files]
    win = {}
    for c in changes:
        if c["client_id"] not in win or (c["seq"], c["change_id"]) > (win[c["client_id"]]["seq"], win[c["client_id"]]["change_id"]):
            win[c["client_id"]] = c
    for i, c in win.items():
        home = max((j for j, f in enumerate(firsts) if f <= i), default=0)
        h = crc(firsts[home]) % 12
        if h > 7:
            continue
        if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
            new[home].pop(i, None)
        else:
            row = dict(new[home].get(i, dict.fromkeys(NAMES) | {"client_id": i}))
            new[home][i] = row | {k: c[k] for k in ("source", "segment", "city", "balance")}
    out = []  # (rows, rewritten)
    for f, n in zip(files, new):
        rows = [n[i] for i in sorted(n)]
        if rows == f:
            out.append((f, False))
            continue
        for piece in cut(rows, most):
            out.append((piece, True))
    joined = []
    for rows, fresh in out:
        if fresh and joined and joined[-1][1] and len(joined[-1][0]) + len(rows) <= most:
            joined[-1] = (joined[-1][0] + rows, True)
        else:
            joined.append((rows, fresh))
    result = []
    for rows, fresh in joined:
        cents = sum(0 if r["balance"] is None else math.floor(100 * r["balance"] + 0.5) for r in rows)
        sums = sum(crc("|".join(r[k] or "" for k in ("source", "segment", "city"))) for r in rows)
        ids = ",".join(str(r["client_id"]) for r in rows)
        result.append((rows[0]["client_id"], len(rows), cents, sums, hashlib.sha256(ids.encode()).hexdigest(), ",".join(NAMES), fresh))
    return result


def table(name, sf):
    r = duckdb.sql(f"SELECT * FROM '/root/testdata/{sf}/{name}.parquet'")
    return [dict(zip(r.columns, x)) for x in r.fetchall()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_upsert_equals_plain_version(spark, sf):
    clients, changes = table("clients", sf), table("client_changes", sf)
    got = upsert.query(spark, f"/root/testdata/{sf}").collect()
    columns = ("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "rewritten")
    want = plain(clients, changes, 1 + len(clients) // 700)
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)
    assert len({r["path"] for r in got}) == len(got) and len({r["rewritten"] for r in got}) == 2
    folder = got[0]["path"].rsplit("/", 1)[0]
    p, fs = upsert._path(spark, folder)
    there = [f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet")]
    assert sorted(there) == sorted(r["path"].rsplit("/", 1)[1] for r in got)


def test_cut_plan_equals_files_one_by_one():
    rng = random.Random(11)
    for _ in range(3000):
        most = rng.randint(1, 9)
        homes = [(rng.random() < 0.7, rng.choice([0, 1, most // 2, most, rng.randint(0, 4 * most)])) for _ in range(rng.randint(0, 9))]
        files = []  # (rows, is new)
        for h, (dirty, n) in enumerate(homes):
            rows = [(h, i) for i in range(n)]
            for f in cut(rows, most) if dirty else [rows]:
                if dirty and files and files[-1][1] and len(files[-1][0]) + len(f) <= most:
                    files[-1] = (files[-1][0] + f, True)
                else:
                    files.append((f, dirty))
        pieces, base, target, used = upsert.cut_plan(homes, most)
        got = {}
        for h, (dirty, n) in enumerate(homes):
            for j, f in enumerate(cut([(h, i) for i in range(n)], most) if dirty else []):
                got.setdefault(target[h] if j == 0 else base[h] + j, []).extend(f)
            assert pieces[h] == (len(cut(range(n), most)) if dirty else 0)
        assert [got[k] for k in sorted(got)] == [f for f, fresh in files if fresh]
        assert not got or min(got) == 0 and max(got) < used


def test_places_and_numbers(spark):
    rng = random.Random(5)
    for size in (0, 1, 2, 9, 50):
        bounds = sorted(rng.sample(range(-100, 100), size))
        rows = spark.range(-110, 110).select("id", upsert.place(F.col("id"), bounds).alias("n")).collect()
        assert all(r["n"] == sum(b <= r["id"] for b in bounds) for r in rows)
    rows = spark.createDataFrame([(rng.choice([7, rng.randint(0, 500)]), i) for i in range(400)], "k long, x int")
    got = upsert.numbered(rows, "k").orderBy("at").collect()
    assert [(r["k"], r["x"]) for r in got] == sorted((r["k"], r["x"]) for r in got) and [r["at"] for r in got] == list(range(400))


def test_upsert_of_odd_rows(spark):
    base = "k long, a string, change string, at int"
    change = "k long, seq int, op string, a string, base string, home int"
    new = lambda b, c, first: F.when(F.coalesce(c["op"], F.lit("")) != "D", F.struct(c["k"].alias("k"), c["a"].alias("a"), b["change"].alias("change"), b["at"].alias("at")))
    rows = [(i, f"a{i}", "x", 1) for i in range(10)] + [(4, "b4", "x", 1), (None, "lost", "x", 1), (10, None, None, None)]
    long = "x" * 100_000
    changes = [(1, 1, "U", "old", "q", 0), (1, 2, "U", long, "q", 0), (1, 2, "U", long, "q", 0), (1, None, "D", None, None, None), (2, 1, None, "a2", None, 1), (None, 9, "U", "lost", None, 1), (-5, 1, "U", "front", None, 1), (99, 1, "U", None, None, 1), (7, 3, "D", None, None, 1), (8, 1, "D", None, None, 1), (77, 1, "D", None, None, 1)]

    def run(rows, changes, per_file=2):
        frame = spark.createDataFrame(rows, base)
        folder = f"{common._folder(spark)}/odd-{uuid.uuid4().hex}"
        upsert.write_sorted(frame, folder, "k", per_file)
        upsert.upsert(spark, folder, frame.schema, spark.createDataFrame(changes, change), "k", ["seq"], new, per_file)
        there = upsert.listed(spark, folder, frame.schema, "k")
        assert all(n <= per_file for _, _, n in there)
        return [tuple(r) for r in spark.read.schema(frame.schema).parquet(folder).orderBy("k").collect()]

    got = run(rows, changes)
    assert [r[0] for r in got] == [-5, 0, 1, 2, 3, 4, 5, 6, 9, 10, 99]
    by = {r[0]: r for r in got}
    assert by[1][1] == long and by[4][1] == "b4" and by[-5] == (-5, "front", None, None) and by[99] == (99, None, None, None) and by[10] == (10, None, None, None)
    assert run(rows, [])[:4] == [(i, f"a{i}", "x", 1) for i in range(4)]
    assert run([], changes) == []
    assert run([(1, "a", "b", 0)], [(1, 1, "D", None, None, 0)]) == []
    hot = run(rows, [(i % 3 + 20, i, "U", str(i), None, 0) for i in range(3000)])
    assert [r[:2] for r in hot[-3:]] == [(20, "2997"), (21, "2998"), (22, "2999")]
