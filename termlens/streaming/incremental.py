"""Incremental versions of the counting steps with Structured Streaming.

The batch original keeps a set of processed ids without end; `dedup="forever"` does the same. A watermark, which
bounds the state and drops what comes later than it, is an addition for long-running streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termlens.functions import stats
from termlens.sources import sinks


def weekly_counts(events: DataFrame, item: str, skill: str, ts: str, delay: str | None = None) -> DataFrame:
    """Items for each skill and ISO week (weeks begin on Monday), each item once: its first row counts."""
    if delay:
        events = events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([item])
    else:
        events = events.dropDuplicates([item])
    rows = events.groupBy(F.window(ts, "1 week", "1 week", "4 days").alias("w"), F.col(skill).alias("skill")).agg(F.count("*").alias("n"))
    return rows.select("skill", stats.iso_week(F.col("w.start")).alias("week"), "n")


def run_weekly(spark: SparkSession, source: str, schema, checkpoint: str, out: str, item: str, skill: str, ts: str, files_per_trigger: int = 1000) -> None:
    """Counts what is new in a folder of Parquet and stops; the table at ``out`` (`sinks.table`) then holds all counts so far."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    counts = weekly_counts(stream, item, skill, ts)

    def write(batch: DataFrame, _: int) -> None:
        sinks.refresh(batch, out)

    counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def count_history(spark: SparkSession, source: str, schema, checkpoint: str, out: str, item: str, skill: str, millis: str, files_per_trigger: int = 1000) -> None:
    """Counts what is new in a folder of Parquet by skill and week, and stops; `history_counts` reads the sums.

    Each item is read once: its first row counts, and one whose time can't be read is done as well, so no later row of it is looked at.
    Only ids are kept as state. A batch's counts are a slice of the table at ``out`` under the batch's number, switched by its manifest: a
    batch that is run again after a failure puts the same slice in its place.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    first = stream.dropDuplicates([item]).select(F.col(skill).alias("skill"), stats.millis_week(F.col(millis)).alias("week"))

    def write(batch: DataFrame, number: int) -> None:
        sinks.refresh_slices(batch.groupBy("skill", "week").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)), out, ("batch",))

    first.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def history_counts(spark: SparkSession, out: str) -> DataFrame:
    """``(skill, week, n)`` of all batches so far; rows without a week are the items that couldn't be read."""
    return sinks.table(spark, out).groupBy("skill", "week").agg(F.sum("n").alias("n"))


def upsert_postings(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends postings whose id the table at ``path`` lacks; a batch that is run again adds nothing."""
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        try:
            known = spark.read.parquet(path).select(key)
            batch = batch.join(known, key, "left_anti")
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.dropDuplicates([key]).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def answers_layer(spark: SparkSession, raw_path: str, known: DataFrame, out: str) -> DataFrame:
    """Saved raw answers grounded anew, without asking again; the raw layer stays as it is."""
    from termlens.operators import grounding

    raw = spark.read.parquet(raw_path).where("call_succeeded")
    sinks.refresh(grounding.grounded(raw, known), out)
    return sinks.table(spark, out)


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A saved state, or an empty one where there is none or it can't be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(ddl).json(path, mode="DROPMALFORMED")
    except AnalysisException:
        return spark.createDataFrame([], ddl)
