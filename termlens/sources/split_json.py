"""JSON files that hold one long array of objects, read by many tasks.

The file is cut at closing braces, as Spark cuts text at a line end, so it doesn't matter where its lines end. What a piece means depends
on whether it begins within a string and how deep in brackets. Quotes that no backslash stands before change the first, whatever the state:
a running parity. Brackets count outside strings only: each block counts its own for both cases, a running sum over the case that holds
gives its depth. With both known, each block cuts out the objects that begin in it, and those that cross blocks are put together
from at most two pieces of a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SIGN = re.compile(r'\\.|["{\[\],:]', re.S)
_PIECE = "file string, block long, at long, kind int, member long, text string"
WHOLE, HEAD, TAIL, KEY = 0, 1, 2, 3
_NESTING = frozenset("{[],")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, value)``: the text between closing braces, in order within a block."""
    rows = spark.read.text(path, lineSep="}")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block its quotes and, for a beginning outside and inside a string, the depth it adds and its commas by depth from there."""
    columns = ["file", "block", "first", "quotes", "depth", "commas"]
    now, first, quotes, depth, commas = None, "", 0, [0, 0], [{}, {}]
    row = lambda: (*now, first, quotes, depth, [[[n, x] for n, x in c.items()] for c in commas])
    for batch in batches:
        out = []
        for file, block, text in zip(batch["file"], batch["block"], batch["value"]):
            if (file, block) != now:
                if now:
                    out.append(row())
                now, first, quotes, depth, commas = (file, block), "", 0, [0, 0], [{}, {}]
            first = first or (text.lstrip("\ufeff \t\r\n") + "}")[0]
            for m in _SIGN.finditer(text):
                c = m[0]
                if c == '"':
                    quotes += 1
                elif c in _NESTING:
                    s = quotes & 1  # outside, if the block begins outside and has had an even number, or inside and an odd one
                    if c in "{[":
                        depth[s] += 1
                    elif c == "]":
                        depth[s] -= 1
                    else:
                        commas[s][depth[s]] = commas[s].get(depth[s], 0) + 1
            depth[quotes & 1] -= 1  # the brace that ends the piece; a file's last piece has none, and no block after it
        yield pd.DataFrame(out, columns=columns)
    if now:
        yield pd.DataFrame([row()], columns=columns)


def _states(pieces: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, int, int]], dict[str, int]]:
    """For each block whether it begins within a string, how deep, and in which member of the outermost object; for each file
    how deep its objects are."""
    rows = pieces.mapInPandas(_count, "file string, block long, first string, quotes long, depth array<int>, commas array<array<array<int>>>").orderBy("file", "block").collect()  # a few numbers for each block
    out, levels, file, state = {}, {}, None, (False, 0, 0)
    for r in rows:
        if r["file"] != file:
            file, state = r["file"], (False, 0, 0)
            levels[file] = 1 if r["first"] == "[" else 2
        out[(file, r["block"])] = state
        inside, depth, member = state
        member += sum(x for n, x in r["commas"][inside] if depth + n == 1)
        state = (inside ^ (r["quotes"] % 2 == 1), depth + r["depth"][inside], member)
    return out, levels


def _cut(states: dict, levels: dict[str, int], wanted: str):
    """The objects of a block, what belongs to one from before, the one that the block's end may cut, and where ``wanted`` is a member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, out = None, 0, []
        inside, depth, member, level = False, 0, 0, 1
        kind, held, of = WHOLE, None, 0  # held: the pieces of an open object, none between objects

        def piece(kind: int, member: int, text: str) -> None:
            nonlocal at
            out.append((*now, at, kind, member, text))
            at += 1

        for batch in batches:
            for file, block, text in zip(batch["file"], batch["block"], batch["value"]):
                if (file, block) != now:
                    if held:
                        piece(kind or TAIL, of, "".join(held))
                    now, at, level = (file, block), 0, levels[file]
                    inside, depth, member = states[now]
                    kind, held, of = (HEAD, [], member) if depth > level else (WHOLE, None, 0)
                start, key, opened = 0, "", 0
                for m in _SIGN.finditer(text):
                    c = m[0]
                    if c == '"':
                        if inside:
                            key = text[opened + 1 : m.start()]
                        opened, inside = m.start(), not inside
                    elif inside:
                        continue
                    elif c in "{[":
                        if held is None and c == "{" and depth == level:
                            start, held, kind, of = m.start(), [], WHOLE, member
                        depth += 1
                    elif c == "]":
                        depth -= 1
                    elif depth == 1 and c == ",":
                        member += 1
                    elif depth == 1 and c == ":" and key == wanted:
                        piece(KEY, member, "")
                if held is not None:
                    held.append(text[start:] + "}")
                if not inside:
                    depth -= 1
                    if held is not None and depth == level:
                        piece(kind, of, "".join(held))
                        kind, held = WHOLE, None
            yield pd.DataFrame(out, columns=["file", "block", "at", "kind", "member", "text"])
            out.clear()
        if held:
            piece(kind or TAIL, of, "".join(held))
        yield pd.DataFrame(out, columns=["file", "block", "at", "kind", "member", "text"])

    return run


def objects(spark: SparkSession, path: str, wanted: str = "results") -> DataFrame:
    """``(file, block, at, text)``: each object of the array that a file is, or that its member ``wanted`` is, as text. Block and place give
    their order. Elements that aren't objects are left out; a file with neither has no rows; what isn't JSON gives no defined result."""
    pieces = _pieces(spark, path)
    states, levels = _states(pieces)
    cut = pieces.mapInPandas(_cut(states, levels, wanted), _PIECE)
    members = {r["file"]: r["member"] for r in cut.where(F.col("kind") == KEY).groupBy("file").agg(F.min("member").alias("member")).collect()}
    lists = [f for f, level in levels.items() if level == 1]
    whole = cut.where(F.col("kind") == WHOLE).select("file", "block", "at", "member", "text")
    order = Window.partitionBy("file").orderBy("block", "kind")  # two rows of a block at most
    parts = cut.where(F.col("kind").isin(HEAD, TAIL)).withColumn("group", F.count_if(F.col("kind") == TAIL).over(order)).groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"), F.min(F.struct("block", "kind", "at", "member")).alias("first"))
    joined = parts.select("file", "first.block", "first.at", "first.member", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    every = whole.unionByName(joined)
    of = spark.createDataFrame([(f, None) for f in lists] + list(members.items()), "file string, own long")
    return every.join(of, "file").where("own is null or own = member").select("file", "block", "at", "text")


def read(spark: SparkSession, path: str, ddl: str, wanted: str = "results") -> DataFrame:
    """The objects' fields, by ``ddl`` (as in ``id long, names array<string>``); what isn't there or isn't of the type is null."""
    return objects(spark, path, wanted).select(F.from_json("text", ddl).alias("row")).select("row.*")
