"""Schemas of the domain's tables, and the relation of programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: DDL of each table. Times stay text where the sources give text; flags are whole numbers.
SCHEMAS = {
    "programs": "program_id long, university string, program_name string, tier string, url string",
    "courses": "course_id long, program_id long, course_code string, course_name string, description string, is_elective int",
    "postings": "posting_id string, source string, title string, company string, location string, description string, salary_min double, salary_max double, posted_date string",
    "skills": "skill_id long, canonical_name string, taxonomy_source string, category string",
    "extractions": "extraction_id long, source_type string, source_id string, skill_id long, confidence double, method string",
    "role_clusters": "cluster_id long, role_label string, method string, silhouette_score double",
    "posting_cluster_map": "posting_id string, cluster_id long",
    "skill_trends": "trend_id long, skill_id long, weeks_covered int, slope double, p_value double, r_squared double, trend_label string, first_half_rate double, second_half_rate double",
    "recommendations": "recommendation_id long, program_id long, skill_id long, gap_value double, trend_label string, priority_score double, priority_tier string, rationale string",
    "gap_scores": "gap_id long, program_id long, skill_id long, cluster_id long, period string, program_coverage_rate double, market_demand_rate double, gap_value double, p_value double, q_value double",
}
# Terms too common to count, for gaps and (three more) for trends and profiles.
GAP_EXCLUDED = ("design", "science", "writing", "monitoring", "programming", "troubleshooting", "mathematics", "coordination", "instructing", "repairing")
TREND_EXCLUDED = (*GAP_EXCLUDED, "speaking", "route", "ada")
# University, program, tier, catalog page.
PROGRAMS = (
    ("Georgia Tech", "MS Analytics (OMS Analytics)", "top-ranked, online", "https://pe.gatech.edu/degrees/analytics/curriculum"),
    ("Georgia Tech", "MS Cybersecurity (OMS Cybersecurity)", "top-ranked, online", "https://pe.gatech.edu/degrees/cybersecurity/curriculum"),
    ("Georgia Tech", "MS Computer Science (main CS catalog)", "top-ranked", "https://catalog.gatech.edu/coursesaz/cs/"),
    ("Arizona State University", "Online Master of Computer Science (MCS)", "online", "https://asuonline.asu.edu/online-degree-programs/graduate/computer-science-mcs/"),
    ("University of Illinois Urbana-Champaign", "MS Computer Science / MCS-DS (CS course catalog)", "top-ranked", "https://catalog.illinois.edu/courses-of-instruction/cs/"),
    ("Northeastern University", "MS Computer Science (Align / CS catalog)", "mid-tier", "https://catalog.northeastern.edu/course-descriptions/cs/"),
    ("Boston University", "MS Computer Science (graduate CS courses)", "top-ranked", "https://www.bu.edu/academics/grs/courses/computer-science/"),
    ("University of Wisconsin-Madison", "MS Computer Sciences / MS Data Science (elective pool)", "top-ranked", "https://guide.wisc.edu/courses/comp_sci/"),
    ("University of Maryland", "MS Computer Science (CMSC catalog)", "top-ranked", "https://academiccatalog.umd.edu/graduate/courses/cmsc/"),
    ("University of Maryland", "Cybersecurity (ENPM catalog)", "top-ranked", "https://academiccatalog.umd.edu/graduate/courses/enpm/"),
    ("Penn State World Campus", "MS Data Analytics (DAAN)", "online", "https://bulletins.psu.edu/university-course-descriptions/graduate/daan/"),
    ("University of Washington", "MSCS / MS Data Science (CSE catalog)", "top-ranked", "https://www.washington.edu/students/crscat/cse.html"),
    ("University of Michigan", "MS Computer Science and Engineering (EECS catalog)", "top-ranked", "https://bulletin.engin.umich.edu/courses/eecs/"),
)


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def programs(spark: SparkSession, rows=PROGRAMS) -> DataFrame:
    """The programs with ids in the order given."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], schema("programs"))


def create(spark: SparkSession, database: str = "default") -> None:
    """Every table as Parquet in the session's catalog, if it isn't there; extractions by kind and method."""
    for name, ddl in SCHEMAS.items():
        parts = " PARTITIONED BY (source_type, method)" if name == "extractions" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet{parts}")
