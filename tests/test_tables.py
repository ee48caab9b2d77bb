"""Refreshes that a failure leaves alone, and numbers in an order."""

import random

import pytest
from pyspark.sql import functions as F

from termlens.sources import numbering, sinks, versions


def ids(spark, path):
    return sorted(r["id"] for r in sinks.table(spark, path).collect())


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.table(spark, path)
    sinks.refresh(spark.range(5), path)
    bad = spark.range(1000).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        sinks.refresh(bad, path)
    assert ids(spark, path) == list(range(5))
    before = sinks.table(spark, path)
    sinks.refresh(before.where("id < 3"), path)  # from the table itself
    assert ids(spark, path) == [0, 1, 2] and before.count() == 5  # a reader under way goes on
    for n in (1, 2):
        sinks.refresh(spark.range(n), path)
    p, fs = versions._at(spark, path)
    assert sum(f.isDirectory() for f in fs.listStatus(p)) == 3 and ids(spark, path) == [0, 1]  # two that are named, one that failed


def test_slices_are_replaced_together(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(i, "course" if i % 2 else "posting", f"m{i % 3}") for i in range(12)], "id long, source_type string, method string")
    sinks.refresh_slices(rows, path)
    new = rows.where("source_type = 'course' and method <> 'm0'").withColumn("id", F.col("id") + 100)
    bad = new.withColumn("id", F.when(F.col("id") == 107, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        sinks.refresh_slices(bad, path)
    assert ids(spark, path) == list(range(12))
    sinks.refresh_slices(new, path)
    want = sorted([i for i in range(12) if not (i % 2 and i % 3)] + [i + 100 for i in range(12) if i % 2 and i % 3])
    assert ids(spark, path) == want
    sinks.refresh_slices(rows.limit(0), path)
    assert ids(spark, path) == want
    whole = str(tmp_path / "w")
    sinks.refresh(rows, whole)
    with pytest.raises(ValueError, match="slices"):
        sinks.refresh_slices(rows, whole)


def test_numbers_follow_the_order(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", "é", "", None, "zz"]) if i % 3 else f"k{rng.randint(0, 50)}", rng.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(data, "name string, n int, x int")
    got = numbering.numbered(df, "id", ["name", "n"], sample=60, ranges=7).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 501))
    assert [(r["name"], r["n"], r["x"]) for r in got] == sorted(data, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1], r[2]))
    assert numbering.numbered(df.limit(0), "id", ["name"]).collect() == []
    assert [r["id"] for r in numbering.numbered(df.limit(1), "id", ["name"]).collect()] == [1]


def test_samples_and_files_of_reports(spark, tmp_path):
    from termlens.operators import clustering
    from termlens.sources import tables
    from termlens.streaming import incremental

    points = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, cluster int")
    took = clustering.members_sample(points).collect()
    assert sorted(r["cluster"] for r in took) == [0] * 8 + [1] * 8 + [2] * 8
    assert sorted(took) == sorted(clustering.members_sample(points.repartition(7)).collect())
    recs = spark.createDataFrame([(1, "U", "P", r, t, f"why {r}", "s", 0.1, 0.2, 0.1, "no clear trend", 1.0 / r, r) for r, t in ((1, "high"), (2, "low"))], "program_id long, university string, program_name string, rank int, priority_tier string, rationale string, canonical_name string, program_coverage_rate double, market_demand_rate double, gap_value double, trend_label string, priority_score double, skill_id long")
    sinks.write_report(recs, str(tmp_path / "report"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "report"), wholetext=True).collect()]
    assert text[0].strip().split("\n") == ["U -- P", "-" * 78, "[HIGH] why 1", "[LOW] why 2"]
    sinks.write_report_csv(recs, str(tmp_path / "csv"))
    assert [r["rank"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("rank").collect()] == ["1", "2"]
    assert incremental.read_or_empty(spark, str(tmp_path / "nothing"), "id long").count() == 0
    (tmp_path / "state.json").write_text('{"id": 1}\n{broken\n')
    assert [r["id"] for r in incremental.read_or_empty(spark, str(tmp_path / "state.json"), "id long").collect()] == [1]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS made LOCATION '{tmp_path}/made'")
    tables.create(spark, "made")
    tables.create(spark, "made")  # what is there stays
    assert spark.table("made.extractions").columns[-2:] == ["source_type", "method"] and spark.table("made.programs").count() == 0
    spark.sql("DROP DATABASE made CASCADE")


def test_answers_are_grounded_again_from_the_raw_layer(spark, tmp_path):
    from termlens.operators import grounding
    from termlens.streaming import incremental

    raw = str(tmp_path / "raw")
    spark.createDataFrame([(1, "- pythn\nzzz", True), (2, None, False)], "item_id long, answer string, call_succeeded boolean").write.parquet(raw)
    words = lambda *t: grounding.lookup(spark.createDataFrame(list(enumerate(t)), "pos long, term string"))
    for terms, want in ((("Python",), (["Python"], 1)), (("Python", "zzzz"), (["Python", "zzzz"], 0))):
        got = incremental.answers_layer(spark, raw, words(*terms), str(tmp_path / "layer")).collect()
        assert [(r["item_id"], r["terms"], r["dropped"]) for r in got] == [(1, *want)]
