"""Text, statistics and dates on literals."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from termlens.functions import stats, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(("args", "z", "significant"), [((20, 100, 20, 100), 0.0, False), ((0, 200, 664, 1660), None, True), ((1, 5, 415, 1660), None, False), ((0, 0, 100, 1000), 0.0, False), ((0, 50, 0, 70), 0.0, False), ((50, 50, 70, 70), 0.0, False)])
def test_two_proportions(spark, args, z, significant):
    cols = [F.lit(a) for a in args]
    r = one(spark, z=stats.two_proportion_z(*cols), p=stats.two_proportion_p(*cols))
    assert (r.p < 0.05) == significant
    if z is None:
        assert r.z > 0
    else:
        assert r.z == z and r.p == 1.0


def test_swapped_groups_turn_the_sign(spark):
    a, b = [F.lit(x) for x in (10, 100, 50, 200)], [F.lit(x) for x in (50, 200, 10, 100)]
    r = one(spark, z1=stats.two_proportion_z(*a), p1=stats.two_proportion_p(*a), z2=stats.two_proportion_z(*b), p2=stats.two_proportion_p(*b))
    assert r.z1 == pytest.approx(-r.z2, abs=1e-10) and r.p1 == pytest.approx(r.p2, abs=1e-10)


def test_normal_cdf(spark):
    for x in (-8.0, -1.96, 0.0, 0.5, 1.96, 4.0, 8.0, 30.0):
        assert one(spark, v=stats.normal_cdf(F.lit(x))).v == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-12)


def test_student_p_at_tabulated_values(spark):
    for df, t in ((1, 12.7062), (2, 4.30265), (3, 3.182446), (4, 2.776445), (5, 2.570582), (10, 2.228139), (30, 2.042272)):
        assert one(spark, p=stats.student_p(F.lit(t), F.lit(df))).p == pytest.approx(0.05, abs=1e-5)


def independent_bh(p):
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    q, low = [0.0] * m, 1.0
    for rank in range(m, 0, -1):
        low = min(low, p[order[rank - 1]] * m / rank)
        q[order[rank - 1]] = low
    return q


def test_false_discovery_rate(spark):
    rng = random.Random(42)
    families = {0: [0.001, 0.01, 0.03, 0.04, 0.2, 0.5, 0.8], 1: [rng.uniform(0.001, 1.0) for _ in range(65)] + [0.0001] * 5, 2: [0.5, 0.5, 0.5]}
    df = spark.createDataFrame([(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)], "f int, i int, p double")
    got = {(r.f, r.i): r.q_value for r in stats.with_q(df, "p", ["f"], ["i"]).collect()}
    for f, ps in families.items():
        for i, (p, q) in enumerate(zip(ps, independent_bh(ps))):
            assert got[f, i] == pytest.approx(q, abs=1e-12) and got[f, i] >= p - 1e-12
    assert sum(got[1, i] < 0.05 for i in range(70)) < sum(p < 0.05 for p in families[1])
    assert all(got[1, i] < 0.05 for i in range(65, 70))
    assert stats.with_q(df.limit(0), "p", ["f"], ["i"]).count() == 0


@pytest.mark.parametrize(("slope", "p", "label"), [(0.02, 0.01, "rising"), (-0.015, 0.03, "falling"), (0.05, 0.5, "no clear trend"), (-0.05, 0.9, "no clear trend"), (0.01, 0.05, "no clear trend"), (0.0, float("nan"), "no clear trend"), (0.1, None, "no clear trend")])
def test_trend_class(spark, slope, p, label):
    assert one(spark, t=stats.classify_trend(F.lit(slope), F.lit(p).cast("double"))).t == label


@pytest.mark.parametrize(("millis", "week"), [("1672531200000", "2022-W52"), ("1704067200000.0", "2024-W01"), ("x", None), ("inf", None), ("", None), (None, None), ("1e300", None)])
def test_weeks_of_milliseconds(spark, millis, week):
    assert one(spark, w=stats.millis_week(F.lit(millis).cast("string"))).w == week


def test_normalize(spark):
    for raw, want in (("  Python   Programming ", "python programming"), ("SQL", "sql"), (None, ""), (" \t\n", ""), ("a b", "a b")):
        assert one(spark, v=text.normalize(F.lit(raw).cast("string"))).v == want == text.normalize_py(raw)


@pytest.mark.parametrize(("term", "doc", "hit"), [("Java", "good with Java", True), ("Java", "with JavaScript", False), ("C++", "5 years of C++ experience", True), ("C++", "Concurrency and parallelism", False), ("C#", "Built APIs in C# and .NET", True), (".NET", "Built APIs in C# and .NET", True), ("Python", "PYTHON", True), ("Python", "python", True), ("SQL", "éSQL", True), ("machine learning", "machine  learning", False)])
def test_term_pattern(spark, term, doc, hit):
    assert one(spark, v=F.lit(doc).rlike(text.term_pattern(term))).v is hit
    assert bool(re.search(text.term_pattern(term), doc)) is hit


@pytest.mark.parametrize(("raw", "want"), [("Machine Learning.", "Machine Learning"), ("Advanced Database Systems credit: 4 Hours.", "Advanced Database Systems"), ("Algorithms (3 Credits)", "Algorithms"), ("Discrete Structures. (4 Hours)", "Discrete Structures"), ("Introduction to Computing. 3 Credit Hours.", "Introduction to Computing"), ("", "")])
def test_titles(spark, raw, want):
    from termlens.sources.catalogs import clean_title

    assert one(spark, v=text.clean_title(F.lit(raw))).v == want == clean_title(raw)


def test_answers(spark):
    raw = "- Python\n2) Docker\n\n* None\nn/a\n• Machine Learning \r\n3. SQL\nnone apply."
    assert one(spark, v=text.answer_terms(F.lit(raw))).v == ["Python", "Docker", "Machine Learning", "SQL"]
    assert one(spark, v=text.answer_terms(F.lit(None).cast("string"))).v == []


def test_rationale(spark):
    def why(name, c, d, g, t):
        return one(spark, v=text.rationale(F.lit(name), F.lit(c), F.lit(d), F.lit(g), F.lit(t))).v

    flat = why("Python", 0.0, 0.40, 0.40, "no clear trend")
    assert "Python" in flat and "40%" in flat and "0%" in flat and "No significant demand trend" in flat
    assert "trending upward" in why("Docker", 0.0, 0.10, 0.10, "rising")
    assert "trending downward" in why("Perl", 0.02, 0.05, 0.03, "falling")
    assert "upward" not in flat and "downward" not in flat
    assert "12%" in why("Go", 0.0, 0.125, 0.125, "no trend data")


def test_summaries_rotate(spark):
    lines = [one(spark, v=text.summary(F.lit("Go"), F.lit(0.01), F.lit(0.5), F.lit("rising"), F.lit(i))).v for i in range(4)]
    assert len(set(lines[:3])) == 3 and lines[3] == lines[0] and all("climbing" in x for x in lines)


def test_latin1_and_search(spark):
    assert one(spark, v=text.latin1(F.lit("Łódź – é"))).v == "?ód? ? é"
    hit = lambda doc, q: one(spark, v=text.contains_ci(F.lit(doc), q)).v
    assert hit("Deep LEARNING", "learn") and hit("axxb", "a%b") and hit("axb", "a_b") and hit("a\\b", "\\") and not hit("ab", "a_b")
