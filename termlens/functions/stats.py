"""Statistics as column expressions: no SciPy, no Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Terms of the series for the normal distribution; enough to about eight standard deviations.
SERIES = 120


def normal_cdf(x: Column) -> Column:
    """``1/2 + phi(x) * (x + x^3/3 + x^5/(3*5) + ...)``, held to [0, 1]; x at most 9 deviations."""
    x = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), x))
    # The square goes along with the sums: a step that named x would work x out again each time.
    start = F.struct(x.alias("term"), x.alias("total"), (x * x).alias("square"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * acc["square"] / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"), acc["square"].alias("square"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), start, step, lambda acc: acc["total"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total))


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z))))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z of the second rate over the first; 0 where a group is empty or the pooled rate is 0 or 1."""
    p1, p2, pool = F.try_divide(x1, n1), F.try_divide(x2, n2), F.try_divide(x1 + x2, n1 + n2)
    variance = pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    return F.when((n1 == 0) | (n2 == 0) | (variance <= 0), F.lit(0.0)).otherwise((p2 - p1) / F.sqrt(variance))


def has_variance(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    return (n1 > 0) & (n2 > 0) & (x1 + x2 > 0) & (x1 + x2 < n1 + n2)


def two_proportion_p(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    return F.when(has_variance(x1, n1, x2, n2), two_sided_p(two_proportion_z(x1, n1, x2, n2))).otherwise(F.lit(1.0))


def bh_q(p: Column, family: list[str], tie: list[str]) -> Column:
    """Benjamini-Hochberg q-values within a family: least of ``p * m / rank`` from this rank up, at most 1.

    Equal p-values get equal q. Two nested windows can't be one expression, so ranks come as arrays: see
    `with_q`, which needs two passes.
    """
    order = Window.partitionBy(*family).orderBy(p, *tie)
    return p * F.count("*").over(Window.partitionBy(*family)) / F.row_number().over(order)


def with_q(df, p: str, family: list[str], tie: list[str], out: str = "q_value"):
    """``df`` with a column of q-values; both windows share one shuffle and one sort."""
    raw = df.withColumn("__raw", bh_q(F.col(p), family, tie))
    from_here = Window.partitionBy(*family).orderBy(p, *tie).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return raw.withColumn(out, F.least(F.lit(1.0), F.min("__raw").over(from_here))).drop("__raw")


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom, by the finite trigonometric sums."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c, s = F.cos(theta), F.sin(theta)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"), (c * c).alias("square"))
    none = F.array().cast("array<int>")

    def run(first: int) -> Column:
        """1 + a c^2 + a b c^4 ...: each factor is (k - 1) / k for k = first, first + 2, ... up to df - 2 (or - 1)."""
        last = df - 2
        steps = F.when(last >= first, F.sequence(F.lit(first), last.cast("int"), F.lit(2))).otherwise(none)

        def step(acc: Column, k: Column) -> Column:
            term = acc["term"] * acc["square"] * (k - 1) / k
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"), acc["square"].alias("square"))

        return F.aggregate(steps, start, step, lambda acc: acc["total"])

    odd = F.when(df == 1, 2 * theta / math.pi).otherwise(2 / math.pi * (theta + s * c * run(3)))
    even = s * run(2)
    inside = F.when(df % 2 == 1, odd).otherwise(even)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - inside))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda acc, v: acc + v))


def classify_trend(slope: Column, p: Column, alpha: float = 0.05) -> Column:
    """``no clear trend`` unless p is below alpha; then by the slope's sign. NaN counts as no trend."""
    return F.when(~(p < alpha) | F.isnan(p) | p.isNull(), "no clear trend").when(slope > 0, "rising").otherwise("falling")


def iso_week(ts: Column) -> Column:
    """``2022-W52`` of a timestamp (the session's time zone should be UTC)."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def millis_week(millis: Column) -> Column:
    """The ISO week of epoch milliseconds in a string (a number with a point too); null where it can't be read."""
    n = millis.try_cast("double")
    return F.when(F.abs(n) < 253402300800000.0, iso_week(F.timestamp_millis(F.when(F.abs(n) < 253402300800000.0, n).cast("long"))))
