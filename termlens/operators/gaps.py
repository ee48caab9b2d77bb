"""Coverage against demand: rates, two-proportion tests, false discovery control, and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions import stats, text
from termlens.sources.tables import GAP_EXCLUDED

MIN_DEMAND, ALPHA = 10, 0.05
RISING, FALLING = 1.5, 0.7
TOP_HIGH, TOP_MEDIUM, TOP_ALL = 3, 7, 10


def course_extractions(extractions: DataFrame, courses: DataFrame) -> DataFrame:
    """Extractions from courses with the course's program. The key is polymorphic text: only rows of the kind are
    cast, and what isn't a number finds no course."""
    rows = extractions.where("source_type = 'course'").select(F.col("source_id").try_cast("long").alias("course_id"), "skill_id")
    return rows.join(courses.select("course_id", "program_id"), "course_id")


def counts(found: DataFrame, item: str, by: list[str], name: str) -> DataFrame:
    """Distinct items for each group."""
    return found.groupBy(*by).agg(F.count_distinct(item).alias(name))


def relevant(demand: DataFrame, skills: DataFrame, least: int = MIN_DEMAND, excluded=GAP_EXCLUDED) -> DataFrame:
    """Demand rows of skills that enough postings name and that aren't too common as words."""
    own = skills.where(~F.lower(F.trim("name")).isin(*excluded))
    return demand.where(F.col("demand_count") >= least).join(own.select("skill_id", "name"), "skill_id")


def rates(coverage: DataFrame, demand: DataFrame, totals: DataFrame, n_postings: DataFrame) -> DataFrame:
    """Every program with courses by every relevant skill, skills that it never covers included.

    ``coverage`` (program, skill_id, n), ``demand`` (skill_id, name, demand_count), ``totals`` (program, n_courses),
    ``n_postings``: one row. The product is programs times relevant skills, both short lists by nature.
    """
    grid = totals.where("n_courses > 0").crossJoin(demand).crossJoin(F.broadcast(n_postings))  # n_postings: one row
    rows = grid.join(coverage, ["program", "skill_id"], "left").withColumn("coverage_count", F.coalesce("n", F.lit(0))).drop("n")
    c, d = F.try_divide("coverage_count", "n_courses"), F.try_divide("demand_count", "n_postings")
    return rows.withColumns({"coverage_rate": c, "demand_rate": d, "gap_value": d - c})


def tested(rows: DataFrame) -> DataFrame:
    """Adds z and p of demand over coverage."""
    args = [F.col(c) for c in ("coverage_count", "n_courses", "demand_count", "n_postings")]
    return rows.withColumns({"z": stats.two_proportion_z(*args), "p_value": stats.two_proportion_p(*args)})


def gap_scores(rows: DataFrame, alpha: float = ALPHA, significant: bool = True) -> DataFrame:
    """Adds q within each program, over all its skills whatever the sign; keeps gaps above 0 with q below alpha."""
    out = stats.with_q(tested(rows), "p_value", ["program"], ["skill_id"])
    return out.where((F.col("gap_value") > 0) & (F.col("q_value") < alpha)) if significant else out


def recommendations(gaps: DataFrame, trends: DataFrame, top: int = TOP_ALL) -> DataFrame:
    """The top gaps of each program, weighted by trend, with rank, tier and reason.

    ``gaps`` (program, skill_id, name, coverage_rate, demand_rate, gap_value), ``trends`` (skill_id, trend_label).
    Skills without a trend row have the label ``no trend data``. Equal scores rank by skill id.
    """
    rows = gaps.join(trends.select("skill_id", "trend_label"), "skill_id", "left").withColumn("trend_label", F.coalesce("trend_label", F.lit("no trend data")))
    weight = F.when(F.col("trend_label") == "rising", RISING).when(F.col("trend_label") == "falling", FALLING).otherwise(1.0)
    rows = rows.withColumn("priority_score", F.col("gap_value") * weight)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("program").orderBy(F.desc("priority_score"), "skill_id"))).where(F.col("rank") <= top)
    rows = rows.withColumn("priority_tier", tier(F.col("rank")))
    return rows.withColumn("rationale", text.rationale(F.col("name"), F.col("coverage_rate"), F.col("demand_rate"), F.col("gap_value"), F.col("trend_label")))


def tier(rank):
    return F.when(rank <= TOP_HIGH, "high").when(rank <= TOP_MEDIUM, "medium").otherwise("low")
