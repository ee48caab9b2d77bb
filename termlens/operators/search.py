"""Substring search that looks at few rows: posting lists of letter triples.

A text that holds a pattern holds every triple of letters of the pattern's plain parts. The index is a table with a row for each triple of a
text, laid out by triple, so that a search reads the lists of its own triples only and keeps the ids that are in all of them. What is left
is held against the pattern itself; wildcards part the pattern, and one without three plain letters in a row looks at all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions import text as tx

GRAM = 3
#: Triples that leave a task at a time.
SENT = 50_000
#: The files of an index; a triple is in one of them.
PARTS = 64


def grams(pattern: str) -> list[str]:
    """The triples that a text must have, lower case; per cent and underscore are wildcards."""
    return sorted({part[i : i + GRAM] for part in re.split("[%_]", pattern.lower()) for i in range(len(part) - GRAM + 1)})


def index(rows: DataFrame, key: str, columns: list[str], parts: int = PARTS) -> DataFrame:
    """``(gram, key)``: the distinct triples of each row's columns. Write it (see `written`) to search it more than once.

    Null texts have none. Triples don't cross from one column to the next.
    """

    kind = rows.schema[key].dataType.simpleString()

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams, at = batch.column(0), [], []
            for i in range(batch.num_rows):
                lows = [t.lower() for c in batch.columns[1:] if (t := c[i].as_py())]
                own = {low[j : j + GRAM] for low in lows for j in range(len(low) - GRAM + 1)}
                grams += own
                at += [i] * len(own)
                if len(grams) >= SENT or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), keys.take(pa.array(at, pa.int64()))], names=["gram", "key"])
                    grams, at = [], []

    found = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(triples, f"gram string, key {kind}").withColumnRenamed("key", key)
    return found.repartition(parts, "gram").sortWithinPartitions("gram").select("gram", key)


def search(rows: DataFrame, postings: DataFrame | None, key: str, columns: list[str], pattern: str) -> DataFrame:
    """Rows of which one of the columns holds the pattern, in any case. ``postings``: the rows' `index`, or none to look at every row.

    Keys are distinct. The result doesn't depend on the index; a row whose key is null is only found without one.
    """
    wanted = grams(pattern)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(tx.contains_ci(F.col(c), pattern), F.lit(False))
    if postings is None or not wanted:
        return rows.where(hit)
    all_of = postings.where(F.col("gram").isin(wanted)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)
    return rows.join(all_of, key, "left_semi").where(hit)
