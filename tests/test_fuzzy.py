"""The filtered join of terms against the plain comparison of all with all."""

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import fuzzy, grounding
from termlens.plans import domain

DATA = "/root/testdata/sf0.01"


def frame(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def test_least_common_is_exact():
    for cutoff in (0.3, 0.5, 0.6, 0.7, 0.85, 1.0):
        for sizes in range(2, 300):
            assert fuzzy.least_common(cutoff, sizes) == min(m for m in range(1, sizes + 1) if 2.0 * m / sizes >= cutoff)


@pytest.mark.parametrize("cutoff", [0.35, 0.7, 0.9, 1.0])
def test_nearest_equals_difflib(spark, cutoff):
    rng = random.Random(int(cutoff * 100))

    def word(letters, most):
        return "".join(rng.choices(letters, k=rng.randint(1, most)))

    pool = [word("abcde", 9) for _ in range(120)] + [word("etaoinshrdluzé🙂 ", 16) for _ in range(120)] + ["a", "b", "aa", "x" * 30, "ab" * 80, "ab" * 79 + "c", "long words of a line " * 12]
    known = sorted(set(pool) | {word("ab", 5) for _ in range(30)})
    asked = {word("abcde", 9) for _ in range(60)} | {word("ab", 3) for _ in range(10)} | {"long words of a line " * 11 + "!", "ab" * 80 + "d", "x" * 28, "", "q"}
    for t in rng.sample(known, 60):  # edits
        i = rng.randrange(len(t))
        asked.add(t[:i] + rng.choice(["", "z", t[i : i + 1] * 2]) + t[i + 1 :])
    got = {r["a"]: (r["b"], r["ratio"]) for r in fuzzy.nearest(frame(spark, sorted(asked)), frame(spark, known), cutoff).collect()}
    for t in asked:
        want = difflib.get_close_matches(t, known, n=1, cutoff=cutoff) if t else []
        assert [got[t][0]] == want if want else t not in got, t
        assert not want or got[t][1] == difflib.SequenceMatcher(None, want[0], t).ratio()


def test_nearest_of_odd_tables(spark):
    none = frame(spark, [])
    some = spark.createDataFrame([("abc",), (None,), ("",)], "term string")
    assert fuzzy.nearest(none, some, 0.7).collect() == [] and fuzzy.nearest(some, none, 0.7).collect() == []
    assert [tuple(r) for r in fuzzy.nearest(some, some, 0.7).collect()] == [("abc", "abc", 1.0)]
    with pytest.raises(ValueError):
        fuzzy.candidates(some, some, 0.0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_words_of_the_tables_equal_difflib(spark):
    raw = domain.read(spark, DATA, "conversations").select(F.explode(tx.words(F.col("text"))).alias("raw")).distinct()
    known = grounding.lookup(domain.skills(spark, DATA), "name", "skill_id")
    got = {r["raw"]: r["term"] for r in grounding.fuzzy(raw, known).collect()}
    names = sorted(r["norm"] for r in known.collect())
    open_terms = [t for t in got if t and t not in set(names)]
    for t in got:
        want = t if t in set(names) else (difflib.get_close_matches(t, names, n=1, cutoff=0.7) or [None])[0]
        assert got[t] == want, t
    pairs = fuzzy.candidates(frame(spark, open_terms), frame(spark, names), 0.7).count()
    print(f"{len(open_terms)} terms, {len(names)} vocabulary terms: {pairs} pairs compared of {len(open_terms) * len(names)}")
    assert pairs < 0.25 * len(open_terms) * len(names)
