"""Extraction quality against labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions import text


def label_sets(labels: DataFrame, buckets: dict[str, str], key: str = "id") -> DataFrame:
    """Distinct ``(key, term)`` from array columns of structs: column -> field that names the term."""
    parts = [labels.select(key, F.explode(c).alias("x")).select(key, text.normalize(F.col("x")[f]).alias("term")) for c, f in buckets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("term <> ''").distinct()


def micro(true: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``(tp, fp, fn, precision, recall, f1)`` over distinct key tuples; 0 where a denominator is 0."""
    t = true.select(*keys).distinct().withColumn("__t", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("__p", F.lit(1))
    both = t.join(p, keys, "full_outer").agg(F.count_if(F.expr("__t = 1 and __p = 1")).alias("tp"), F.count_if(F.expr("__t is null")).alias("fp"), F.count_if(F.expr("__p is null")).alias("fn"))
    both = both.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))})
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def missing(true: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Labelled items without any prediction row."""
    return true.select(key).distinct().join(predicted.select(key), key, "left_anti")


def compare(base: DataFrame, other: DataFrame) -> DataFrame:
    """Metric by metric: both values and the difference."""
    names = ["precision", "recall", "f1"]
    a = base.unpivot([], names, "metric", "baseline")
    b = other.unpivot([], names, "metric", "other")
    return a.join(b, "metric").withColumn("delta", F.col("other") - F.col("baseline"))
