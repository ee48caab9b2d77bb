"""Language identification: gradients, every position, held-out accuracy, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import langid

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_pred string, p int, score double, window int"


def plain_states(net, x, d):
    """One window (L,), one direction, a step at a time."""
    width = net.U.shape[2]
    h, out = np.zeros(width), {}
    for t in range(len(x)) if d == 0 else reversed(range(len(x))):
        a, u = net.E[d][:, x[t]].astype(float), net.U[d].astype(float)
        z = np.clip(a[:width] + u[:width] @ h + 0.5, 0, 1)
        r = np.clip(a[width : 2 * width] + u[width : 2 * width] @ h + 0.5, 0, 1)
        c = np.clip(a[2 * width :] + r * (u[2 * width :] @ h), -1, 1)
        h = z * h + (1 - z) * c
        out[t] = h
    return np.array([out[t] for t in range(len(x))])


def test_states_equal_single_steps():
    net = langid.Network.new(["a", "b", "c"], width=5, seed=1)
    x = np.random.default_rng(2).integers(0, 256, (11, 4)).astype(np.uint8)
    got = net.states(x)
    for i in range(4):
        want = np.concatenate([plain_states(net, x[:, i], 0), plain_states(net, x[:, i], 1)], axis=1)
        assert np.allclose(got[:, :, i], want, atol=1e-5)
    assert np.allclose(net.positions(got).sum(axis=1), 1, atol=1e-5)


def test_gradients_equal_differences():
    net = langid.Network.new(["a", "b", "c"], width=4, seed=3)
    for p in net.parameters():
        p *= 0.5  # away from the corners of the gates
    rng = np.random.default_rng(4)
    x = rng.integers(97, 110, (7, 6)).astype(np.uint8)
    labels, weights = rng.integers(0, 3, 6), rng.integers(0, 2, (7, 6)).astype(np.float32)
    _, grads = net.gradients(x, labels, weights)
    wide = langid.Network(net.languages, *(p.astype(float) for p in net.parameters()))

    def loss():
        states = np.stack([np.concatenate([plain_states(wide, x[:, i], 0), plain_states(wide, x[:, i], 1)], axis=1) for i in range(6)])
        o = states @ wide.V.T + wide.b[:, 0]
        p = np.exp(o) / np.exp(o).sum(axis=2, keepdims=True)
        return -sum(np.log(p[i, :, labels[i]]) @ weights[:, i] for i in range(6)) / weights.sum()

    for p, g in zip(wide.parameters(), grads):
        places = [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g), axis=None)[:12]]
        for at in places:
            before = p[at]
            p[at] = before + 1e-5
            up = loss()
            p[at] = before - 1e-5
            down = loss()
            p[at] = before
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=2e-4, rel=2e-2)


def test_whole_texts_are_read():
    net = langid.Network.new(["a", "b"], width=4, seed=5)
    text = "Some WORDS, of é ü one text. " * 50 + "12 34"
    blob = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    total, n = np.zeros(2), 0
    for s in range(0, len(blob), 32):  # window by window, position by position
        w = np.zeros(32, dtype=np.uint8)
        w[: len(blob[s : s + 32])] = blob[s : s + 32]
        states = np.concatenate([plain_states(net, w, 0), plain_states(net, w, 1)], axis=1)
        for t in range(32):
            if w[t] >= 0x80 or chr(w[t]).isalpha():
                e = np.exp(net.V @ states[t] + net.b[:, 0])
                total, n = total + e / e.sum(), n + 1
    got = langid.pooled(net, ["x", text, "12"], window=32, batch=7)
    assert np.allclose(got[1], total / n, atol=1e-4)
    assert got[2].tolist() == [0, 0]
    assert np.allclose(langid.pooled(net, [text], window=32, batch=7)[0], got[1], atol=1e-6)


def test_held_out_rows_are_told(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.query(spark, DATA).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").toPandas()
    assert len(got) == docs.count() and set(got.columns) >= {"doc_id", "held_out", "lang_pred", "score"}
    assert got["score"].between(0, 1).all()
    out = got[got["held_out"] & (got["n"] >= 100)]
    assert len(out) > 100 and (out["lang"] == out["lang_pred"]).mean() >= 0.97


def test_languages_of_odd_rows(spark):
    a, b = "lorem ipsum dolor sit amet ", "zwölf große öfen überall "
    texts = [(i, (a if i % 2 else b) * 5 + str(i), "la" if i % 2 else "xx") for i in range(40)]
    odd = [(100, None, "la"), (101, "", "xx"), (102, "12 - !", None), (None, a, None), (103, b * 20_000, None), (104, a, "xx"), (104, a, "xx"), (105, "z", None)]
    docs = spark.createDataFrame([(*r, "q", 1, 0.1, 2) for r in texts + odd], SCHEMA)
    net = langid.learn(docs.where("doc_id < 40"))
    rows = langid.predict(docs, net).collect()
    assert len(rows) == len(texts) + len(odd)
    by = {r["doc_id"]: r for r in rows}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[None]["lang_pred"] == "la" and by[103]["lang_pred"] == "xx" and by[105]["lang_pred"] in ("la", "xx")
    assert by[104]["lang_pred"] == "la" and 0 < by[104]["score"] <= 1
    none = spark.createDataFrame([], SCHEMA)
    assert langid.learn(none) is None and langid.learn(docs.where("lang is null")) is None
    assert langid.predict(none, net).collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    # A hot text counts once: the sample is bounded by different texts.
    hot = docs.where("doc_id = 1").crossJoin(spark.range(500).select()).unionByName(docs.where("doc_id < 40"))
    assert langid.sample(hot, 20).count() <= 2 * 40 * langid.FIT_WINDOWS
