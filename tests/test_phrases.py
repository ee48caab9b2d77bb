"""Phrases and symbols of a vocabulary table against plain patterns, and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import extraction, phrases


def both(spark, docs, terms):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    table = spark.createDataFrame([(t, 1) for t in terms], "name string, term int")
    out = []
    for mode in ("all", "longest"):
        rows = extraction.extract(frame, table.select("name"), mode=mode).collect()
        out.append([{r["term"] for r in rows if r["doc_id"] == i} for i in range(len(docs))])
        assert len(rows) == len(set(rows))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_terms_equal_plain_patterns(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "data", "c++", "c#", ".net", "x_1", "é", "+", "-", "node.js", "(", "MIT", "a-b", "ab", "😀"]
    terms = {"a", "a b", "b c", "c", "c++", "c#", ".net", "x_1", "c data a", "node.js", "a-b", "a-b c", "(", "+", "mit", "data (", "é", "é a", " padded  term ", "b, c", "c, c++ +", "++", "data 😀 c"}
    terms |= {" ".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(30)} | {"a " * 70 + "b"}
    docs = ["".join(rng.choice(["", " ", " ", "  ", ", ", "\n", " "]) + rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    docs += ["Padded term", "a " * 71 + "b", "the " + "a " * 70 + "bc", "C++C# c++ +.NET", "x" * 5000, None, ""]
    every, longest = both(spark, docs, sorted(terms))
    norms = {t for t in map(tx.normalize_py, terms) if t}
    pattern = re.compile(tx.any_term_pattern(sorted(norms)), re.ASCII)
    for i, doc in enumerate(docs):
        low = (doc or "").lower()
        assert every[i] == {t for t in norms if re.search(tx.term_pattern(t), low, re.ASCII)}, doc
        assert longest[i] == {m[1] for m in pattern.finditer(low)}, doc


def test_filter_lets_every_term_through(spark):
    rng = random.Random(9)
    terms = sorted({"".join(rng.choices("abc+ .", k=rng.randint(1, 9))).strip() for _ in range(3000)} - {""})
    f = phrases.build(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert all(f.may_be("".join(phrases.tokens(t))) and len(phrases.tokens(t)) in f.lengths(phrases.tokens(t)[0]) for t in terms)
    others = [f"zz{i}" for i in range(5000)]
    assert sum(f.may_be(t) for t in others) < 100


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (1, "two three", "y"), (1, "two three", "y"), (None, "one two", None), (2, None, "x"), (3, "one two " * 60_000, "x")], "doc_id long, text string, term string")
    table = spark.createDataFrame([("One",), ("one two",), ("Two ",), (None,), ("",), ("two",)], "term string")
    got = {(r[0], r[1]) for r in phrases.extract(docs, table).collect()}
    assert got == {(i, t) for i in (1, None, 3) for t in ("one", "two", "one two")}
    longest = phrases.extract(docs, table, mode="longest")
    assert {(r[0], r[1]) for r in longest.collect()} == {(1, "one two"), (1, "two"), (None, "one two"), (3, "one two")}
    kept = phrases.extract(docs.withColumn("lang", F.lit("en")), table, keep=("lang",)).collect()
    assert {r["lang"] for r in kept} == {"en"} and len(kept) == len(got)
    none = docs.where("false")
    for mode in ("all", "longest"):
        assert phrases.extract(none, table, mode=mode).collect() == []
        assert phrases.extract(docs, table.where("false"), mode=mode).collect() == []


def test_spans_leave_a_task_in_small_batches(spark, monkeypatch):
    """However many runs the texts of a batch have, a task holds those of about ``SENT`` only."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SENT", 10)
    schema = pa.schema([("row", pa.int64()), ("term", pa.string())])
    batch = pa.RecordBatch.from_pydict({"row": list(range(50)), "text": ["a b c d"] * 50})
    out = list(phrases._sent(iter([batch]), schema, lambda row, text: ((row, t) for t in text.split())))
    assert max(b.num_rows for b in out) <= 13 and sum(b.num_rows for b in out) == 200
    docs = spark.createDataFrame([(i % 7, "one two one " * (i % 5), i % 3) for i in range(60)], "doc_id long, text string, row int")
    table = spark.createDataFrame([("one two",), ("one",)], "term string")
    got = {tuple(r) for r in phrases.extract(docs, table, mode="longest", keep=("row",)).collect()}
    assert got == {(i % 7, i % 3, t) for i in range(60) if i % 5 for t in ("one two", "one")}
