"""The test tables as the domain's tables: English documents are postings, other languages programs with their
documents as courses, words of the benchmark the vocabulary, sources the role clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import extraction, gaps
from termlens.operators import trends as trend
from termlens.sources import sinks, stage
from termlens.sources.tables import TREND_EXCLUDED

MIN_WORD = 4
POSTINGS = "en"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills(spark: SparkSession, d: str) -> DataFrame:
    """(skill_id, name): distinct words of the benchmark, numbered by name."""
    names = read(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("name")).distinct().where(F.length("name") >= MIN_WORD)
    return sinks.with_ids(names, "skill_id", ["name"]).select("skill_id", "name")


def phrases(spark: SparkSession, d: str) -> DataFrame:
    """(term): the benchmark's words, its pairs of words with one space between, and words with a sign right after them."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+|[^a-z0-9_]"), F.lit(0))
    rows = read(spark, d, "benchmark").select(tokens.alias("t")).select("t", F.explode(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1)))).alias("i"))
    at = lambda k: F.try_element_at("t", F.col("i") + k)
    pair, signed = F.when(at(1) == " ", F.concat(at(0), F.lit(" "), at(2))), F.when(~at(1).rlike(r"[a-z0-9_\s]"), F.concat(at(0), at(1)))
    terms = rows.select(F.explode(F.array(at(0), pair, signed)).alias("term"))
    return terms.select(F.trim("term").alias("term")).where(F.col("term").rlike("^[a-z0-9_]")).distinct()


def found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (doc_id, lang, source, skill_id)."""
    return extraction.extract_words(read(spark, d, "documents"), skills(spark, d), keep=("lang", "source"))


def coverage(f: DataFrame) -> DataFrame:
    return gaps.counts(f.where(F.col("lang") != POSTINGS).withColumnRenamed("lang", "program"), "doc_id", ["program", "skill_id"], "n")


def demand(f: DataFrame) -> DataFrame:
    return gaps.counts(f.where(F.col("lang") == POSTINGS), "doc_id", ["skill_id"], "demand_count")


def totals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("lang") != POSTINGS).groupBy(F.col("lang").alias("program")).agg(F.count("*").alias("n_courses"))


def extracted(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    """`found`, written once for the queries that count it in several ways: the texts are read for it only."""
    own = stage.written(skills(spark, d)) if own is None else own
    return stage.written(extraction.extract_words(read(spark, d, "documents"), own, keep=("lang", "source")))


def rates(spark: SparkSession, d: str, f: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    own = stage.written(skills(spark, d)) if own is None else own
    f = extracted(spark, d, own) if f is None else f
    n = read(spark, d, "documents").where(F.col("lang") == POSTINGS).agg(F.count("*").alias("n_postings"))
    return gaps.rates(coverage(f), gaps.relevant(demand(f), own), totals(spark, d), n)


def gap_scores(spark: SparkSession, d: str, f: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    return gaps.gap_scores(rates(spark, d, f, own))


def sightings(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, doc_id, week): the history of postings; a week is the date of its Monday. The tables have no dates of documents; each
    event shows the document with the number of its user, counted on from the first document after the last."""
    events = read(spark, d, "events").select("event_id", "user_id", F.trunc("ts", "week").alias("week"))
    n = read(spark, d, "documents").agg(F.count("*").alias("n"))
    return events.crossJoin(F.broadcast(n)).where("n > 0").select("event_id", F.pmod("user_id", "n").alias("doc_id"), "week")  # n: one row


def skill_trends(spark: SparkSession, d: str, f: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """(skill_id, slope, p_value, .., trend_label): the weekly demand of each skill that isn't too common as a word."""
    own = stage.written(skills(spark, d)) if own is None else own
    f = extracted(spark, d, own) if f is None else f
    own = own.where(~F.lower(F.trim("name")).isin(*TREND_EXCLUDED)).select("skill_id")
    seen = sightings(spark, d)
    named = f.select("doc_id", "skill_id").join(own, "skill_id")
    counts = stage.written(trend.weekly_by(seen, named, "event_id", "doc_id", "skill_id", "week"))
    rates = trend.dense_rates(counts, trend.kept_weeks(seen, "event_id", "week"))
    return trend.regression(rates).withColumnRenamed("skill", "skill_id")


def trends(spark: SparkSession, d: str, f: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    return skill_trends(spark, d, f, own).select("skill_id", "trend_label")


def recommendations(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    own = stage.written(skills(spark, d))
    f = extracted(spark, d, own) if f is None else f
    return gaps.recommendations(gap_scores(spark, d, f, own), trends(spark, d, f, own))


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Frames with the domain's schemas (as far as the views read them), all from one extraction."""
    docs = read(spark, d, "documents")
    programs = sinks.with_ids(docs.where(F.col("lang") != POSTINGS).select("lang").distinct(), "program_id", ["lang"])
    programs = programs.select("program_id", "lang", F.concat(F.lit("University of "), F.upper("lang")).alias("university"), F.lit("Catalog").alias("program_name"))
    code = programs.select("program_id", F.col("lang").alias("program"))
    own = stage.written(skills(spark, d))
    f = extracted(spark, d, own)
    kind = F.when(F.col("lang") == POSTINGS, "posting").otherwise("course")
    found_gaps = stage.written(gap_scores(spark, d, f, own))  # a row for a program and skill
    scores = found_gaps.join(code, "program").select("program_id", "skill_id", F.col("coverage_rate").alias("program_coverage_rate"), F.col("demand_rate").alias("market_demand_rate"), "gap_value", "p_value", "q_value")
    recs = gaps.recommendations(found_gaps, trends(spark, d, f, own)).join(code, "program").select("program_id", "skill_id", "gap_value", "trend_label", "priority_score", "priority_tier", "rationale", "rank")
    clusters = sinks.with_ids(docs.select(F.col("source").alias("role_label")).distinct(), "cluster_id", ["role_label"])
    return {
        "programs": programs.drop("lang"),
        "courses": docs.join(programs.select("program_id", "lang"), "lang").select(F.col("doc_id").alias("course_id"), "program_id", F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("course_code"), F.substring("text", 1, 40).alias("course_name"), F.col("text").alias("description")),
        "postings": docs.where(F.col("lang") == POSTINGS).select(F.col("doc_id").cast("string").alias("posting_id"), F.lit("kaggle_sample").alias("source"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("company"), F.lit(None).cast("string").alias("location"), F.col("text").alias("description")),
        "skills": own.withColumnRenamed("name", "canonical_name"),
        "extractions": f.select(kind.alias("source_type"), F.col("doc_id").cast("string").alias("source_id"), "skill_id", F.lit("keyword").alias("method")),
        "gap_scores": scores,
        "recommendations": recs,
        "role_clusters": clusters,
        "posting_cluster_map": docs.where(F.col("lang") == POSTINGS).join(clusters.withColumnRenamed("role_label", "source"), "source").select(F.col("doc_id").cast("string").alias("posting_id"), "cluster_id"),
    }
