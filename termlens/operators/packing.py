"""Vectors as packed blocks on a grid, for jobs where all meet all.

Rows are dealt to ``lines`` by their id, and each batch becomes one row of bytes for each line. A cell of the grid gets the blocks of
one line from both sides. Each side is sent ``lines`` times at most, a number that doesn't grow until a line holds ``BYTES`` of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the vectors of a line, lines of a small grid at most, rows of a line of a small grid.
BYTES, LINES, ROWS = 1 << 26, 8, 1024


def lines(sides: list[DataFrame], more: int = 0) -> int:
    """How many lines the grid of frames with ``size`` (numbers of a vector) needs; ``more``: numbers that a task keeps for each row."""
    n = wide = 1
    for side in sides:
        r = side.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
        n, wide = max(n, r["n"]), max(wide, r["size"] or 1)
    return max(min(LINES, -(-n // ROWS)), -(-n * wide * 8 // BYTES), -(-n * more * 8 // (3 * BYTES)))


def schema(columns: list[str]) -> str:
    return "size int, line int, vectors binary, " + ", ".join(f"{c} binary" for c in columns)


def chunks(size: int, vectors: np.ndarray, columns: dict[str, np.ndarray], lines: int) -> Iterator[pd.DataFrame]:
    """A batch's rows of one size as a row of bytes for each line; ``id``, a whole number, is one of the columns."""
    line = (columns["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(lines)
    rows = []
    for i in np.unique(line):
        at = line == i
        rows.append((size, int(i), vectors[at].astype("<f8").tobytes(), *[c[at].tobytes() for c in columns.values()]))
    yield pd.DataFrame(rows, columns=["size", "line", "vectors", *columns])


def unpacked(blocks: pd.DataFrame, kinds: dict[str, type]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vectors of blocks of one size as a matrix, and the columns."""
    vectors = np.frombuffer(b"".join(blocks["vectors"]), dtype="<f8").reshape(-1, int(blocks["size"].iloc[0]))
    return vectors, [np.frombuffer(b"".join(blocks[c]), dtype=k) for c, k in kinds.items()]


def grid(a: DataFrame, b: DataFrame, lines: int, run: Callable, kind: str, half: bool = False) -> DataFrame:
    """``run`` for each cell, given the blocks of ``a`` in its row and those of ``b`` in its column. ``half``: only cells whose column
    isn't before their row, for frames that are the same."""
    last, line = F.lit(lines - 1), F.col("line")
    left = a.withColumn("i", line).withColumn("j", F.explode(F.sequence(line if half else F.lit(0), last)))
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of its own, if both sides are one frame
    right = b.withColumn("j", line).withColumn("i", F.explode(F.sequence(F.lit(0), line if half else last)))
    key = ["size", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, kind)
