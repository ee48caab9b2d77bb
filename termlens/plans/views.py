"""The dashboard's queries as functions from tables to frames (schemas: `termlens.sources.tables`).

Where the original order has ties, an id breaks them; limits without an order get one by key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import extraction, search
from termlens.sources.tables import TREND_EXCLUDED


def overview(t: dict[str, DataFrame], sample: str = "kaggle_sample") -> DataFrame:
    """One row of totals."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(t["programs"], "programs")
    for df, name in ((t["courses"], "courses"), (t["postings"].where(F.col("source") == sample), "postings"), (t["gap_scores"], "gaps"), (t["recommendations"], "recommendations")):
        out = out.crossJoin(one(df, name))
    return out


def program_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.concat_ws(" -- ", "university", "program_name"))


def program_explorer(t: dict[str, DataFrame], program_id: int) -> DataFrame:
    """A program's recommendations with rates and names, high tiers first."""
    recs = t["recommendations"].where(F.col("program_id") == program_id)
    gaps = t["gap_scores"].select("program_id", "skill_id", "program_coverage_rate", "market_demand_rate", "p_value", "q_value")
    rows = recs.join(gaps, ["program_id", "skill_id"]).join(t["skills"].select("skill_id", "canonical_name"), "skill_id", "left")
    return rows.orderBy(tier_order(F.col("priority_tier")), F.desc("priority_score"), "skill_id")


def tier_order(tier):
    return F.when(tier == "high", 1).when(tier == "medium", 2).otherwise(3)


def course_finder(t: dict[str, DataFrame], text: str = "", skills: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Courses whose name or description holds the text and that name one of the skills; nothing if neither is given.

    With the courses' `search.index` as ``t["course_index"]`` only courses that have the text's triples of letters are read.
    """
    rows = t["courses"].join(t["programs"].select("program_id", "university", "program_name"), "program_id")
    if not text and not skills:
        return rows.limit(0)
    if text:
        rows = search.search(rows, t.get("course_index"), "course_id", ["course_name", "description"], text)
    if skills:
        wanted = t["skills"].where(F.col("canonical_name").isin(list(skills))).select("skill_id")
        found = t["extractions"].where("source_type = 'course'").join(wanted, "skill_id", "left_semi")
        rows = rows.join(found.select(F.col("source_id").try_cast("long").alias("course_id")), "course_id", "left_semi")
    return rows.orderBy("university", "course_code", "course_id").limit(limit)


def compare(t: dict[str, DataFrame], program_ids: list[int], n: int = 8) -> DataFrame:
    """The top recommendations of several programs in one frame."""
    rows = t["recommendations"].where(F.col("program_id").isin(list(program_ids)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("program_id").orderBy(F.desc("priority_score"), "skill_id"))).where(F.col("place") <= n)
    return program_label(rows.join(t["programs"], "program_id")).join(t["skills"].select("skill_id", "canonical_name"), "skill_id", "left").orderBy("label", "place")


def short_labels(programs: DataFrame) -> DataFrame:
    """``(program_id, label)``: a short university name; repeats are numbered (2), (3) by university and id."""
    short = F.replace("university", F.lit("University of "), F.lit("U. "))
    n = F.row_number().over(Window.partitionBy("short").orderBy("university", "program_id"))
    rows = programs.withColumn("short", short).withColumn("n", n)
    return rows.select("program_id", F.when(F.col("n") == 1, F.col("short")).otherwise(F.concat("short", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("label"))


def top_skills(gap_scores: DataFrame, n: int = 10) -> DataFrame:
    """The skills with the most gaps."""
    return gap_scores.groupBy("skill_id").agg(F.count("*").alias("n_gaps")).orderBy(F.desc("n_gaps"), "skill_id").limit(n)


def heatmap(t: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """``(program_id, label, skill_id, canonical_name, rate)`` for every program by the top skills, 0 where it has none."""
    skills = top_skills(t["gap_scores"], n).join(t["skills"].select("skill_id", "canonical_name"), "skill_id")
    own = t["courses"].groupBy("program_id").agg(F.count("*").alias("n_courses"))
    found = t["extractions"].where("source_type = 'course'").select(F.col("source_id").try_cast("long").alias("course_id"), "skill_id")
    counted = found.join(t["courses"].select("course_id", "program_id"), "course_id").groupBy("program_id", "skill_id").agg(F.count_distinct("course_id").alias("n"))
    grid = short_labels(t["programs"]).crossJoin(skills.select("skill_id", "canonical_name"))
    rows = grid.join(own, "program_id", "left").join(counted, ["program_id", "skill_id"], "left")
    return rows.select("program_id", "label", "skill_id", "canonical_name", F.coalesce(F.try_divide("n", "n_courses"), F.lit(0.0)).alias("rate"))


def heatmap_matrix(long: DataFrame, names: list[str]) -> DataFrame:
    return long.groupBy("label").pivot("canonical_name", names).agg(F.first("rate")).na.fill(0.0)


def color_top(long: DataFrame) -> DataFrame:
    """The scale's upper end: the greatest rate, 0.05 at least."""
    return long.agg(F.greatest(F.max("rate"), F.lit(0.05)).alias("top"))


def trends(t: dict[str, DataFrame], label: str) -> DataFrame:
    """Skills of one trend, steepest first, with points a week."""
    order = F.asc("slope") if label == "falling" else F.desc("slope")
    rows = t["skill_trends"].where(F.col("trend_label") == label).join(t["skills"].select("skill_id", "canonical_name"), "skill_id")
    return rows.withColumn("points_per_week", F.col("slope") * 100).orderBy(order, "skill_id")


def halves(rows: DataFrame) -> DataFrame:
    """The two half rates as rows."""
    out = rows.unpivot(["skill_id"], ["first_half_rate", "second_half_rate"], "period", "rate")
    return out.withColumn("period", F.when(F.col("period") == "first_half_rate", "First half").otherwise("Second half"))


def trend_table(rows: DataFrame) -> DataFrame:
    """Trend rows as they are shown."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    return rows.select("skill_id", tx.trend_display(F.col("trend_label")).alias("trend"), pct("first_half_rate").alias("first_half"), pct("second_half_rate").alias("second_half"), F.format_string("%.4f", "p_value").alias("p"))


def clusters(t: dict[str, DataFrame]) -> DataFrame:
    """Every cluster with its postings, empty ones too, largest first."""
    rows = t["role_clusters"].join(t["posting_cluster_map"], "cluster_id", "left")
    return rows.groupBy("cluster_id", "role_label").agg(F.count("posting_id").alias("n_postings")).orderBy(F.desc("n_postings"), "cluster_id")


def cluster_postings(t: dict[str, DataFrame], cluster_id: int, limit: int = 8) -> DataFrame:
    own = t["posting_cluster_map"].where(F.col("cluster_id") == cluster_id).select("posting_id")
    return t["postings"].join(own, "posting_id", "left_semi").select("posting_id", "title", "company", "location").orderBy("posting_id").limit(limit)


def tracked_skills(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["skills"].join(t["extractions"].where("source_type = 'posting'").select("skill_id").distinct(), "skill_id", "left_semi")
    return rows.where(~F.lower(F.trim("canonical_name")).isin(*TREND_EXCLUDED))


def cluster_top_skills(found: DataFrame, members: DataFrame, n: int = 15) -> DataFrame:
    """``(cluster_id, skill_id, n, total, demand_rate, place)``: the skills that most of a cluster's items name."""
    totals = members.groupBy("cluster_id").agg(F.count("*").alias("total"))
    pairs = found.select("item_id", "skill_id").repartition("item_id").distinct().join(members.select("item_id", "cluster_id").repartition("item_id").distinct(), "item_id")
    rows = pairs.where("item_id is not null").groupBy("cluster_id", "skill_id").agg(F.count("*").alias("n")).join(totals, "cluster_id")
    rows = rows.withColumn("demand_rate", F.try_divide("n", "total"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("demand_rate"), "skill_id"))).where(F.col("place") <= n)


def role_match(top: DataFrame, mine: DataFrame) -> DataFrame:
    """``(cluster_id, score)``: the share of a cluster's top skills that a person has (of as many as there are)."""
    rows = top.join(mine.select("skill_id", F.lit(1).alias("have")), "skill_id", "left")
    return rows.groupBy("cluster_id").agg(F.avg(F.coalesce("have", F.lit(0)).cast("double")).alias("score"))


def have_missing(top: DataFrame, mine: DataFrame, cluster_id: int) -> DataFrame:
    """A cluster's top skills, each with whether the person has it."""
    return _held(top.where(F.col("cluster_id") == cluster_id), mine)


def _held(rows: DataFrame, mine: DataFrame) -> DataFrame:
    have = rows.join(mine.select("skill_id"), "skill_id", "left_semi").withColumn("have", F.lit(True))
    return have.unionByName(rows.join(mine.select("skill_id"), "skill_id", "left_anti").withColumn("have", F.lit(False)))


def profile_match(t: dict[str, DataFrame], text: str) -> tuple[DataFrame, DataFrame]:
    """A person's text against the roles: (roles by score, the best role's skills with ``have``)."""
    tracked = tracked_skills(t)
    mine = extraction.profile_skills(text, tracked)
    found = t["extractions"].where("source_type = 'posting'").select(F.col("source_id").alias("item_id"), "skill_id").join(tracked.select("skill_id"), "skill_id", "left_semi")
    named = t["role_clusters"].where(~F.col("role_label").ilike("mixed%"))
    members = t["posting_cluster_map"].join(named.select("cluster_id"), "cluster_id", "left_semi").select(F.col("posting_id").alias("item_id"), "cluster_id")
    top = cluster_top_skills(found, members)
    roles = role_match(top, mine).join(named, "cluster_id").orderBy(F.desc("score"), "cluster_id").limit(5)
    best = roles.orderBy(F.desc("score"), "cluster_id").limit(1).select("cluster_id")
    return roles, _held(top.join(best, "cluster_id", "left_semi"), mine)


def program_report(t: dict[str, DataFrame], program_id: int, day: date | None = None) -> dict[str, DataFrame]:
    """What the printed report of a program shows: counts and the date (``day``, else today), table, and the three first high
    ones in changing words."""
    rows = program_explorer(t, program_id)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("priority_tier") == "high").alias("n_high"), F.count_if(F.col("trend_label") == "rising").alias("n_rising"))
    counts = counts.withColumn("report_date", F.lit(day) if day else F.current_date())
    place = F.row_number().over(Window.orderBy(F.desc("priority_score"), "skill_id")) - 1
    high = rows.where("priority_tier = 'high'").withColumn("variant", place).where("variant < 3")
    prose = high.select("variant", tx.latin1(tx.summary(F.col("canonical_name"), F.col("program_coverage_rate"), F.col("market_demand_rate"), F.col("trend_label"), F.col("variant"))).alias("line"))
    return {"counts": counts, "table": rows, "prose": prose}


def profile_report(roles: DataFrame, skills: DataFrame, postings: DataFrame) -> dict[str, DataFrame]:
    """What the printed profile shows: six roles, ten strengths, ten gaps, six postings."""
    ordered = skills.orderBy("place")
    return {"roles": roles.limit(6), "have": ordered.where("have").limit(10), "missing": ordered.where("not have").limit(10), "postings": postings.limit(6)}
