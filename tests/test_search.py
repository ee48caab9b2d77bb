"""Substring search through the index against plain matching, and the history's counts."""

import random
import re

from termlens.operators import search
from termlens.streaming import incremental


def plain(text, pattern):
    p = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return text is not None and re.search(p, text, re.I | re.S) is not None


def test_search_equals_plain_matching(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([None, "", "ab"]) if i % 9 == 0 else "".join(rng.choices("abcÄé% _\\x\n", k=rng.randint(0, 40))), "".join(rng.choices("ABC d", k=6))) for i in range(400)]
    rows = spark.createDataFrame(data, "id long, gram string, n string")
    postings = search.index(rows, "id", ["gram", "n"]).cache()
    patterns = ["abc", "ABC", "a_c", "ab%ca", "äé", "\\x", "bcd%abc", "b", "", "%", "abc_%d", "c d", "ab ab ab ab", "é% _"]
    for p in patterns:
        want = {i for i, a, b in data if plain(a, p) or plain(b, p)}
        assert {r["id"] for r in search.search(rows, postings, "id", ["gram", "n"], p).collect()} == want, p
        assert {r["id"] for r in search.search(rows, None, "id", ["gram", "n"], p).collect()} == want, p
    kept = postings.where("gram = 'abc'").count()
    assert 0 < kept < 250 and search.grams("ab%cde_xyz") == ["cde", "xyz"] and search.grams("a%b_") == []
    assert search.search(rows.limit(0), search.index(rows.limit(0), "id", ["n"]), "id", ["n"], "abc").collect() == []


def test_history_is_counted_once(spark, tmp_path):
    schema = "job_id string, skill string, listed string"
    week = lambda w: str(1704067200000 + w * 7 * 86_400_000)  # noqa: E731  2024-W01 and on
    first = [("a", "sql", week(0)), ("b", "sql", "1.7040672E12"), ("bad", "sql", "soon"), ("c", "go", week(2)), ("none", "go", None)]
    second = [("a", "sql", week(3)), ("bad", "sql", week(0)), ("d", "sql", week(0)), ("none", "go", week(1)), ("e", "go", week(2))]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.count_history(spark, source, spark.createDataFrame([], schema).schema, check, out, "job_id", "skill", "listed")
        return {(r["skill"], r["week"]): r["n"] for r in incremental.history_counts(spark, out).collect()}

    assert run(first) == {("sql", "2024-W01"): 2, ("sql", None): 1, ("go", "2024-W03"): 1, ("go", None): 1}
    want = {("sql", "2024-W01"): 3, ("sql", None): 1, ("go", "2024-W03"): 2, ("go", None): 1}
    assert run(second) == want
    assert run([]) == want  # a restart without new rows


def test_triples_leave_a_task_in_small_batches(spark, monkeypatch):
    """A task doesn't hold the triples of a whole batch of texts."""
    monkeypatch.setattr(search, "SENT", 5)
    rows = spark.createDataFrame([(i, f"abc{i:03d}xyz", None) for i in range(40)], "id long, a string, b string")
    got = sorted((r["id"], r["gram"]) for r in search.index(rows, "id", ["a", "b"]).collect())
    assert got == sorted((i, t[j : j + 3]) for i in range(40) for t in (f"abc{i:03d}xyz",) for j in range(7))
