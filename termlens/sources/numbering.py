"""Row numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose keys cut the ranges, in expectation, and ranges at most.
SAMPLE, RANGES = 2000, 200


def numbered(df: DataFrame, name: str, order: list[str], sample: int = SAMPLE, ranges: int = RANGES) -> DataFrame:
    """``df`` with the numbers 1, 2, .. in ``name``, by the columns ``order`` (nulls first), equal rows of these by the other columns.

    The keys of a sample, taken by hash, cut the rows into ranges. Each range is numbered on its own, from the number of rows before it on.
    The driver sees the sample's keys and a count for each range. Columns have types that can be ordered and hashed.
    """
    key = F.struct(*order)
    n = df.count()
    share = F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < F.lit((1 << 30) * sample // max(n, sample))
    found = sorted(r["k"] for r in df.where(share & F.forall(F.array(*[F.col(c).isNotNull() for c in order]), lambda x: x)).select(key.alias("k")).distinct().collect())
    step = max(1, -(-len(found) // ranges))
    bounds = found[step - 1 :: step]
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    cuts = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(b, order)]).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind}>")
    rows = df.withColumn("__range", F.size(F.filter(cuts, lambda b: b < key)))
    sizes = {r["__range"]: r["count"] for r in rows.groupBy("__range").count().collect()}
    before = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(bounds) + 1)]
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order, *[c for c in df.columns if c not in order]))
    return rows.withColumn(name, F.get(F.lit(before).cast("array<bigint>"), F.col("__range")) + place).drop("__range")
