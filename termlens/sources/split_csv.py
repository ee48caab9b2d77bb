"""CSV files with line breaks in quoted fields, read by many tasks.

Whether a line break ends a record depends on how many quotes stand before it in the file: an even number, and it does. So
the file is cut at any line, as Spark cuts text, and read twice. The first pass counts the quotes of each block. An exclusive running sum of
these parities tells the second pass in which state its block begins, so each block finds its records on its own. A record that
crosses blocks is put together from its pieces: at most two of a block.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Longest field, as the readers of the whole library have it.
FIELD = 10_000_000
_PIECE = "file string, block long, kind int, at long, record string"
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """``(file, block, value)``: lines in the order of the file within a block, a carriage return still at their end."""
    rows = spark.read.options(**options).text(path, lineSep="\n")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _parities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        quotes = batch["value"].str.count('"')
        yield quotes.groupby([batch["file"], batch["block"]]).sum().rename("quotes").reset_index()[["file", "block", "quotes"]]


def _states(lines: DataFrame) -> DataFrame:
    """``(file, block, inside)``: whether a block begins within quotes. One row for each block of a file."""
    counted = lines.mapInPandas(_parities, "file string, block long, quotes long").groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(inside: dict[tuple[str, int], bool]):
    """A block's pieces, numbered: what belongs to a record from before, whole records, and the record that the block's end may cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, quoted, kind, at, held, out = None, False, WHOLE, 0, [], []

        def piece(kind: int) -> None:
            nonlocal at, held
            out.append((*now, kind, at, "\n".join(held)))
            at, held = at + 1, []

        for batch in batches:
            for file, block, line in zip(batch["file"], batch["block"], batch["value"]):
                if (file, block) != now:
                    if held:
                        piece(kind or TAIL)
                    now, quoted, at = (file, block), inside[(file, block)], 0
                    kind = HEAD if quoted else WHOLE
                held.append(line)
                quoted ^= line.count('"') % 2 == 1
                if not quoted:
                    piece(kind)
                    kind = WHOLE
            yield pd.DataFrame(out, columns=["file", "block", "kind", "at", "record"])
            out.clear()
        if held:
            piece(kind or TAIL)
        yield pd.DataFrame(out, columns=["file", "block", "kind", "at", "record"])

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """The records that cross blocks: a block's tail with the heads that follow it, in order."""
    cut = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind")  # HEAD before TAIL, two rows of a block at most
    numbered = cut.withColumn("group", F.count_if(F.col("kind") == TAIL).over(order))
    # A tail begins a group; the heads of the blocks after it end it.
    parts = numbered.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"), F.min(F.struct("block", "kind", "at")).alias("first"))
    return parts.select("file", "first.block", "first.at", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))


def _fields(record: str) -> list[str | None]:
    csv.field_size_limit(FIELD)
    return next(csv.reader([record.removesuffix("\r")], quoting=csv.QUOTE_NOTNULL), [])


def records(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """``(file, block, at, record)``: the records of all files as the text they are, without their line end; the file's block and the place
    there where a record begins give their order. Blank lines are left out."""
    lines = _lines(spark, path, options or {})
    inside = {(r["file"], r["block"]): r["inside"] for r in _states(lines).collect()}  # one bit for each block of a file
    pieces = lines.mapInPandas(_cut(inside), _PIECE)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "at", "record")
    return whole.unionByName(_joined(pieces)).where(~F.col("record").rlike(r"\A\r?\z"))


def read(spark: SparkSession, path: str, columns: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """All-string rows of the CSV files at ``path`` by the header of each file, and ``file``. Columns that a file lacks are null; without
    ``columns`` those of all headers, by name.

    Fields are parted by commas; quoted ones may hold commas, line breaks and doubled quotes, others no quotes. An empty field is
    null, a quoted empty one is the empty string; short rows end in nulls, what is beyond the header is left out. Lines end with a line feed,
    with or without a carriage return. The rows have no order; files without a line have no rows.
    """
    rows = records(spark, path, options)
    first = rows.where("block = 0").groupBy("file").agg(F.min(F.struct("at", "record")).alias("x"))
    heads = {r["file"]: (r["x"]["at"], _fields(r["x"]["record"].removeprefix("\ufeff"))) for r in first.collect()}  # one row for each file
    columns = columns if columns is not None else sorted({c for _, own in heads.values() for c in own if c})
    places = {file: (at, [own.index(c) if c in own else None for c in columns]) for file, (at, own) in heads.items()}
    names = [f"c{i}" for i in range(len(columns))]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, block, at, record in zip(batch["file"], batch["block"], batch["at"], batch["record"]):
                head, place = places[file]
                if block or at != head:
                    f = _fields(record)
                    out.append((file, *(f[p] if p is not None and p < len(f) else None for p in place)))
            yield pd.DataFrame(out, columns=["file", *names], dtype=object)

    parsed = rows.mapInPandas(parse, ", ".join(f"{c} string" for c in ("file", *names)))
    return parsed.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "file")
