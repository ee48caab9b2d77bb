"""Importance resampling against a plain version, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from termlens.llm import resampling

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, rank int, weight long, before int, bucket int"


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target):
    """Every feature as a string, hashed on its own; one sort of all documents."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out, able = {}, []
    for i, text in docs:
        w, f = plain_features(text)
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(f), weight, score, None]
        if len(w) >= 20:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: 25 * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(x) for i, x in out.items()}


def result(df):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


def test_buckets_equal_hashes_of_whole_runs():
    for text in ["", " - ", "One two  TWO three-4 é É ñandú 5x", "a " * 70_000, "ﬁ A_B \x7f{}` ß"]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        for n in (1, 2, 3):
            want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in range(1, n + 1) for i in range(len(w) - k + 1))
            got = Counter(b for piece in resampling.buckets(text, n, 97) for b in piece)
            assert got == want
            assert not w or resampling._words_of(sum(got.values()), n) == len(w)


def test_draw_equals_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    target = [r[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
    got = result(resampling.query(spark, DATA))
    assert got == plain(rows, target)
    assert sum(x[3] is not None for x in got.values()) > 200


def test_draw_of_odd_rows(spark):
    long = "word and other words here " * 40_000
    texts = [(0, None), (1, ""), (2, " \t"), (3, "few words only"), (4, long), (5, "é ñ " * 30), (None, "null id " * 20), (7, "tie " * 30), (7, "tie " * 30)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in texts], SCHEMA)
    target = spark.createDataFrame([("word and other", 1), (None, 2)], "text string, item_id int")
    rows = resampling.resample(docs, target, percent=80).collect()
    assert len(rows) == len(texts)
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4]
    assert [r["weight"] for r in rows if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    assert {r["n_features"] for r in rows if r["doc_id"] == 4} == {2 * 5 * 40_000 - 1}
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, target).collect() == []
    alone = resampling.resample(docs, none).collect()
    assert len(alone) == len(texts)
    assert [r["rank"] for r in resampling.resample(docs.where("doc_id = 3"), target).collect()] == [None]


def test_equal_scores_go_by_the_smaller_id(spark):
    rows = [(i, 20 if i % 7 else 19, 39, 0, 5 if i < 60 else 6) for i in range(100)] + [(3, 20, 39, 0, 5), (None, 20, 39, 0, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = resampling.draw(frame, 20, 50).collect()
    able = sorted((-s, -1 if i is None else i) for i, w, _, _, s in rows if w >= 20)
    drawn = sorted((r["rank"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["rank"])
    assert drawn == [(k, i) for k, (_, i) in enumerate(able[: len(able) // 2], 1)]
    assert len(got) == len(rows)
