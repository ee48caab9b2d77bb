"""Writers: first write wins, keyed update, surrogate keys, and report lines; `versions` has the refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.sources import numbering
from termlens.sources.versions import refresh, refresh_slices, table  # noqa: F401


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; of equal new keys the first by ``order`` stays."""
    if order:
        new = first_wins(new, [key], [order])
    else:
        new = new.dropDuplicates([key])
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def keyed_update(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``old`` with ``column`` from ``new`` where the key is there (the greatest of several values) and not null."""
    values = new.groupBy(key).agg(F.max(column).alias("__new"))
    return old.join(values, key, "left").withColumn(column, F.coalesce("__new", column)).select(*old.columns)


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key: the first in the order (use descending columns for the last)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def with_ids(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Row numbers 1, 2, .. in an order (`numbering.numbered`)."""
    return numbering.numbered(df, name, order)


def write_json(df: DataFrame, path: str, without: tuple[str, ...] = ()) -> None:
    """JSON lines of all columns but those named in ``without``."""
    df.drop(*without).write.mode("overwrite").json(path)


def report_lines(recommendations: DataFrame) -> DataFrame:
    """The text report, one row a line ``(program_id, line_no, line)``: a heading, a rule, then a tagged line for
    each recommendation by rank."""
    rows = recommendations.select("program_id", F.lit(2).alias("kind"), F.col("rank").alias("at"), F.concat(F.lit("["), F.upper("priority_tier"), F.lit("] "), "rationale").alias("line"))
    heads = recommendations.select("program_id", F.concat_ws(" -- ", "university", "program_name").alias("line")).distinct()
    heads = heads.select("program_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("at"), F.col("line")), F.struct(F.lit(1).alias("kind"), F.lit(0).alias("at"), F.lit("-" * 78).alias("line")))).alias("x")).select("program_id", "x.*")
    every = heads.unionByName(rows)
    return every.select("program_id", F.row_number().over(Window.partitionBy("program_id").orderBy("kind", "at")).alias("line_no"), "line")


def write_report(recommendations: DataFrame, path: str) -> None:
    """A folder of text files, one for each program, lines in order."""
    lines = report_lines(recommendations)
    text = lines.groupBy("program_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy("program_id").text(path)


def report_table(recommendations: DataFrame) -> DataFrame:
    """The spreadsheet's rows: rank, skill, tier, rates, gap, trend as shown."""
    from termlens.functions.text import trend_display

    order = Window.orderBy(F.desc("priority_score"), "skill_id")
    return recommendations.select(F.row_number().over(order).alias("rank"), F.col("canonical_name").alias("skill"), F.initcap("priority_tier").alias("priority"), F.round("program_coverage_rate", 4).alias("coverage"), F.round("market_demand_rate", 4).alias("demand"), F.round("gap_value", 4).alias("gap"), trend_display(F.col("trend_label")).alias("trend"))


def write_report_csv(recommendations: DataFrame, path: str) -> None:
    report_table(recommendations).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
