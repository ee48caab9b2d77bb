"""Readers: CSV with line breaks in fields, JSON with explicit schemas, SQL with parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.sources import split_csv, split_json

JOB = "id string, title string, description string, created string, redirect_url string, salary_is_predicted string, salary_min double, salary_max double, latitude double, longitude double, company struct<display_name:string>, location struct<display_name:string,area:array<string>>, category struct<label:string,tag:string>"
TECHNOLOGY = "category_code long, category_title string, examples array<struct<title:string,hot_technology:boolean,in_demand:boolean>>, used_by_occupations array<string>"
SKILL = "id string, name string, description string, onet_category string, used_by_occupations array<string>"
COURSE = "program string, course_code string, course_name string, description string"


def query(spark: SparkSession, sql: str, params: tuple = ()) -> DataFrame:
    """SQL with ``?`` markers over the session's views."""
    return spark.sql(sql, args=list(params)) if params else spark.sql(sql)


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string CSV by header name; quoted fields may hold line breaks and doubled quotes. Large files are read by many tasks."""
    return split_csv.read(spark, path, columns).select(*columns)


def csv_tree(spark: SparkSession, root: str) -> DataFrame:
    """All CSV files below a folder, with ``source_name``: the path below the folder, separators as underscores."""
    rows = split_csv.read(spark, root, options={"recursiveFileLookup": "true", "pathGlobFilter": "*.csv"})
    below = F.regexp_replace(F.col("file"), rf"^.*?{root.strip('/').split('/')[-1]}/", "")
    return rows.withColumn("source_name", F.regexp_replace(below, "/", "_")).drop("file")


def json_list(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON files that hold an array of objects, or an object with the array in ``results``; large ones are read by many tasks."""
    return split_json.read(spark, path, ddl)


json_list_or_results = json_list


def postings_from_jobs(jobs: DataFrame, source: str) -> DataFrame:
    """Rows of the jobs interface as postings; the date stays as the text it is."""
    return jobs.select(F.col("id").alias("posting_id"), F.lit(source).alias("source"), "title", F.col("company.display_name").alias("company"), F.col("location.display_name").alias("location"), "description", "salary_min", "salary_max", F.col("created").alias("posted_date"))


def prop(column: Column | str, path: str, kind: str) -> Column:
    """A scalar out of a JSON string, by path; null where it is missing or not of the kind."""
    return F.get_json_object(column, path).try_cast(kind)
