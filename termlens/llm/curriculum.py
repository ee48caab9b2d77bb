"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, ... and share all words; a source gives
at most ``cap`` times its own words, and what it can't give is shared again by weight. The fixed point of that
is a water level: with sources sorted by cap over weight, the first k are full and the others take weight
times level, which one window over the table of sources finds.

Positions: the share of a source changes while training goes on. Its weight at time u in [0, 1] is
``1 + a - 2 a u`` times its mean, so its demand up to u is ``target * ((1 + a) u - a u^2)``. A document's place in
its source's queue (words before it, in an order by hash) is a demand; solving for u gives the time at which
the mix reads it, and the result is range-sorted by that time.

The queue is a running sum over a source, which may hold a third of all rows: it is split into ``BUCKETS``
ranges of the hash order; sums of ranges make the offsets, and each range runs on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlens.llm import common

#: A document, and so a source, is taken at most this often.
CAP = 3
WEIGHTS = (1, 2, 3)
#: Slope a of the schedule for each of WEIGHTS: light sources late, heavy sources early.
SLOPES = (-0.5, 0.0, 0.5)
#: Ranges of a source's hash order: the first three hexadecimal digits.
BUCKETS = 16**3


def _named(i: str) -> str:
    return f"__mix_{i}"


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """``(is_null, src, source_size, weight, slope, target, asked)`` from rows ``(is_null, src, size)``.

    ``asked`` is the target in whole words. The table of sources is small beside the documents; only it runs
    through windows without a key.
    """
    every = Window.orderBy("is_null", "src")
    own = sizes.groupBy("is_null", "src").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(every) - 1) % len(WEIGHTS)
    own = own.withColumn("place", place)
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("place") + 1)).withColumn("slope", F.element_at(F.array(*map(F.lit, SLOPES)), F.col("place") + 1))
    own = own.withColumn("most", F.lit(cap) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), "is_null", "src")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level)
    # The level is the one of the first source that it doesn't fill; all full happens only with nothing to share.
    own = own.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("is_null"), F.col("src"), F.col("level").alias("at")))).over(whole)["at"])
    own = own.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce("water", F.lit(0.0))))
    return own.select("is_null", "src", "source_size", "weight", "slope", "target", F.round("target").cast("long").alias("asked"))


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, passes, part_taken, queue, slope, asked`` appended.

    Names that ``docs`` has already are kept: the operator's own columns carry a prefix until the caller
    chooses (see `query` and `repeated`). Sizes count maximal runs of other than white space; null texts have
    size 0 and are never taken, nor are empty ones. Null sources are one source, the last. Rows with equal
    doc_id each count; rows that are equal throughout are exchangeable. An empty table gives an empty result.
    """
    n = _named
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumns({n("size"): F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long"), n("is_null"): F.col("source").isNull(), n("src"): F.coalesce(F.col("source").cast("string"), F.lit("")), n("key"): key})
    rows = rows.withColumn(n("bucket"), F.substring(n("key"), 1, 3))
    small = common.cut(rows.select(F.col(n("is_null")).alias("is_null"), F.col(n("src")).alias("src"), F.col(n("bucket")).alias("bucket"), F.col(n("size")).alias("size")).groupBy("is_null", "src", "bucket").agg(F.sum("size").alias("size")))
    offsets = small.withColumn("offset", F.coalesce(F.sum("size").over(Window.partitionBy("is_null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = offsets.drop("size").join(targets(small, cap), ["is_null", "src"])
    plan = plan.select(*[F.col(c).alias(n(c)) for c in plan.columns])
    keys = [n("is_null"), n("src"), n("bucket")]
    within = Window.partitionBy(*keys).orderBy(n("key"), F.col("doc_id"), n("size")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(n("before"), F.coalesce(F.sum(n("size")).over(within), F.lit(0))).join(plan, keys)
    out = out.withColumn(n("queue"), F.col(n("before")) + F.col(n("offset")))
    full = F.when(F.col(n("source_size")) > 0, F.expr(f"{n('asked')} div {n('source_size')}")).otherwise(F.lit(0))
    out = out.withColumn(n("full"), full)
    rest = F.col(n("asked")) - F.col(n("full")) * F.col(n("source_size"))
    out = out.withColumn(n("part_taken"), F.greatest(F.lit(0), F.least(F.col(n("size")), rest - F.col(n("queue")))))
    return out.withColumn(n("taken"), F.col(n("full")) * F.col(n("size")) + F.col(n("part_taken")))


def _time(demand, slope):
    """u with ``(1 + a) u - a u^2 = demand``, the inverse of the integrated schedule."""
    inner = F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * demand)
    return F.when(slope == 0, demand).otherwise(((1 + slope) - F.sqrt(inner)) / (2 * slope))


def position(pass_no, taken_in_pass):
    """When the mix reads the middle of this pass of a document, from 0 to 1."""
    n = _named
    words = pass_no * F.col(n("source_size")) + F.col(n("queue")) + taken_in_pass / 2
    return _time(F.least(F.lit(1.0), words / F.greatest(F.lit(1), F.col(n("asked")))), F.col(n("slope")))


def repeated(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass over a document, range-sorted by training position.

    A last pass that takes less than half of a document is left out, else it counts as the whole document. Rows without
    a word (null texts too) aren't taken; null ids and repeated rows are taken like others; an empty table gives an empty one.
    """
    n = _named
    rows = mix(docs, cap)
    passes = F.col(n("full")).cast("int") + F.when((F.col(n("part_taken")) > 0) & (2 * F.col(n("part_taken")) >= F.col(n("size"))), 1).otherwise(0)
    rows = rows.where(F.col(n("size")) > 0).withColumn(n("passes"), passes).where(F.col(n("passes")) > 0)
    rows = rows.withColumn(n("pass"), F.explode(F.sequence(F.lit(0), F.col(n("passes")) - 1)))
    rows = rows.withColumn(n("position"), position(F.col(n("pass")), F.col(n("size"))))
    return rows.orderBy(n("position"), "doc_id").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_curriculum``: the mix of all ``documents``; ``position`` is the first pass's, null if not taken."""
    n = _named
    rows = mix(common.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.when(F.col(n("full")) > 0, F.col(n("size"))).otherwise(F.col(n("part_taken")))
    out = rows.select("doc_id", *[F.col(n(c)).alias(c) for c in ("size", "source_size", "target", "taken")], F.when(F.col(n("taken")) > 0, position(F.lit(0), first)).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM s),
c AS (SELECT *, place + 1 AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][place + 1] AS slope, 3 * source_size AS most FROM w),
l AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
t AS (SELECT *, least(most::DOUBLE, weight * coalesce((SELECT min_by(level, most / weight) FROM l WHERE level * weight <= most), 0)) AS target FROM l),
a AS (SELECT *, round(target)::BIGINT AS asked FROM t),
q AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, a.asked, a.slope,
         CASE WHEN a.source_size > 0 THEN a.asked // a.source_size ELSE 0 END AS fullp,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS queue
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
p AS (SELECT *, greatest(0, least(size, asked - fullp * source_size - queue)) AS part FROM q),
z AS (SELECT *, (fullp * size + part)::BIGINT AS taken,
        least(1.0::DOUBLE, (queue + (CASE WHEN fullp > 0 THEN size ELSE part END)::DOUBLE / 2::DOUBLE)::DOUBLE / greatest(1, asked)::DOUBLE) AS demand FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN demand
         ELSE ((1 + slope) - sqrt(greatest(0.0::DOUBLE, (1 + slope) * (1 + slope) - 4 * slope * demand))) / (2 * slope) END END AS position
FROM z
"""
