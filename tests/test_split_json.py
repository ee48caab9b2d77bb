"""The split JSON reader against the standard parser, with blocks of a few bytes."""

import json
import random

import pytest

from termlens.sources import files, split_json


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind < 4:
        return rng.choice(["", "a", 'q"uo"te', "back\\slash", "{[", "]}", "}{,:", '\\"', "\\\\", "é🙂\n", "x" * 150, "results", 1, -2.5, None, True])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "results", "}", '"', "c:d"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def texts(spark, path):
    return [json.loads(r["text"]) for r in split_json.objects(spark, path).orderBy("block", "at").collect()]


@pytest.mark.parametrize("seed", range(2))
def test_objects_equal_the_parser(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    made = [{"id": i, "v": value(rng), "w": value(rng)} for i in range(40)] + [{}]
    (tmp_path / "list.json").write_text(json.dumps(made, ensure_ascii=bool(seed), indent=seed or None))
    assert texts(spark, str(tmp_path / "list.json")) == made
    around = {"count": 3, "note": "\"results\": [{", "other": [{"id": -1}], "meta": {"a": {"results": [{}]}}, "results": made, "after": {"x": {"id": -2}, "y": [{"id": -3}]}}
    (tmp_path / "wrapped.json").write_text(json.dumps(around, indent=1 - seed or None))
    assert texts(spark, str(tmp_path / "wrapped.json")) == made
    assert split_json.objects(spark, str(tmp_path / "wrapped.json")).select("block").distinct().count() > 15


def test_fields_of_several_files(spark, tmp_path, small_blocks):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('  [{"id": 1, "name": "x}"}, {"id": "no number", "tags": ["p", "q"]}]\n')
    (tmp_path / "in" / "b.json").write_text('{"next": null, "results": [{"id": 3}, 7, null, {"id": 4, "more": {"deep": [{"id": 9}]}}]}')
    (tmp_path / "in" / "c.json").write_text("[]")
    (tmp_path / "in" / "d.json").write_text('{"results": []}')
    (tmp_path / "in" / "e.json").write_text('{"other": [{"id": 5}]}')
    (tmp_path / "in" / "f.json").write_text("")
    got = files.json_list(spark, str(tmp_path / "in"), "id long, name string, tags array<string>").collect()
    assert sorted(((r["id"], r["name"], r["tags"]) for r in got), key=str) == sorted([(1, "x}", None), (None, None, ["p", "q"]), (3, None, None), (4, None, None)], key=str)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.json").write_text("[]")
    assert files.json_list(spark, str(tmp_path / "none"), "id long").collect() == []
