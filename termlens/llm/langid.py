"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are lower-cased and cut into windows of ``WINDOW`` bytes; no byte is left out. Two layers of ``WIDTH`` gated units read
each window, one from either end, and a softmax over both gives every position a probability of each language. A
document's probabilities are the means over its letter positions, the best of them its language.

The gates are piecewise linear (``clip(x + 1/2, 0, 1)``, and ``clip(x, -1, 1)`` for the candidate), which numpy works out
several times faster than the smooth curves:

    z = gate(Ez[byte] + Uz h)    r = gate(Er[byte] + Ur h)    c = candidate(Ec[byte] + r * (Uc h))    h' = z h + (1 - z) c

Training is backpropagation through time with Adam on windows of a bounded sample of labelled rows; it runs on the
driver, since the sample doesn't grow. Prediction is a map over the documents with the network's few kilobytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common

#: Labelled texts that the fit reads, in expectation; of more, a share by the hash of the text. Copies count once.
FIT_ROWS = 6_000
#: Windows of one text that the fit reads, at places spread over the whole text, and their bytes.
FIT_WINDOWS, FIT_BYTES = 6, 64
#: Most languages that are learned; of more, the most frequent.
LANGUAGES = 64
WIDTH, WINDOW = 8, 128
#: Windows that go through the network together.
BATCH = 768
STEPS, RATE, SEED = 420, 0.02, 7
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, dtype=np.float32)
_IS_LETTER[ord("a") : ord("z") + 1] = 1
_IS_LETTER[0x80:] = 1


@dataclass
class Network:
    """``E``: (2, 3 H, 256) what a byte adds to the gates z, r and the candidate, by direction; ``U``: (2, 3 H, H); ``V``: (C, 2 H)."""

    languages: list[str]
    E: np.ndarray
    U: np.ndarray
    V: np.ndarray
    b: np.ndarray

    @classmethod
    def new(cls, languages: list[str], width: int = WIDTH, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        E = rng.normal(0, 0.3, (2, 3 * width, 256))
        U = rng.normal(0, 0.5 / np.sqrt(width), (2, 3 * width, width))
        V = rng.normal(0, 0.3, (len(languages), 2 * width))
        return cls(languages, *(x.astype(np.float32) for x in (E, U, V, np.zeros((len(languages), 1)))))

    def parameters(self) -> list[np.ndarray]:
        return [self.E, self.U, self.V, self.b]

    def states(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """(L, 2 H, B) states after each byte of the windows ``x`` (L, B), of both directions."""
        size, n = x.shape
        h3, width = self.U.shape[1:]
        out = np.empty((size, 2 * width, n), dtype=np.float32)
        x = x.astype(np.intp)
        a, g = np.empty((2, h3, n), dtype=np.float32)
        for d in (0, 1):
            E, U = self.E[d], self.U[d]
            h = np.zeros((width, n), dtype=np.float32)
            for t in range(size) if d == 0 else range(size - 1, -1, -1):
                np.take(E, x[t], axis=1, out=a, mode="clip")
                np.matmul(U, h, out=g)
                gates, c = a[: 2 * width], a[2 * width :]
                gates += g[: 2 * width]
                gates += 0.5
                np.clip(gates, 0, 1, out=gates)
                z, r, m = gates[:width], gates[width:], g[2 * width :]
                if tape is not None:
                    tape.append((t, h.copy(), z.copy(), r.copy(), m.copy()))
                m *= r
                c += m
                np.clip(c, -1, 1, out=c)
                if tape is not None:
                    tape[-1] += (c.copy(),)
                h -= c
                h *= z
                h += c
                out[t, d * width : (d + 1) * width] = h
        return out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """(L, C, B) probabilities of each position."""
        p = np.matmul(self.V, states)
        p += self.b
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the weighted positions and its gradients, by backpropagation through time."""
        tape: list = []
        states = self.states(x, tape)
        p = self.positions(states)
        size, n = x.shape
        width = self.U.shape[2]
        total = max(1.0, float(weights.sum()))
        loss = float(-(np.log(np.maximum(p[:, labels, np.arange(n)], 1e-12)) * weights).sum() / total)
        p[:, labels, np.arange(n)] -= 1
        p *= weights[:, None, :] / total
        dV = np.einsum("tcn,thn->ch", p, states, optimize=True)
        db = p.sum(axis=(0, 2))[:, None]
        dstates = np.matmul(self.V.T, p)
        onehot = None
        dE, dU = np.zeros_like(self.E), np.zeros_like(self.U)
        for d in (1, 0):
            dh = np.zeros((width, n), dtype=np.float32)
            da = np.empty((size, 3 * width, n), dtype=np.float32)
            for _ in range(size):
                t, h, z, r, m, c = tape.pop()
                dh += dstates[t, d * width : (d + 1) * width]
                dz = dh * (h - c) * ((z > 0) & (z < 1))
                dc = dh * (1 - z) * (np.abs(c) < 1)
                dr = dc * m * ((r > 0) & (r < 1))
                da[t] = np.concatenate([dz, dr, dc])
                du = np.concatenate([dz, dr, dc * r])
                dU[d] += du @ h.T
                dh *= z
                dh += self.U[d].T @ du
            if onehot is None:
                onehot = np.zeros((size * n, 256), dtype=np.float32)
                onehot[np.arange(size * n), x.ravel()] = 1
            dE[d] = da.transpose(1, 0, 2).reshape(3 * width, -1) @ onehot
        return loss, [dE, dU, dV.astype(np.float32), db.astype(np.float32)]


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = 192, rate: float = RATE, width: int = WIDTH, seed: int = SEED) -> Network:
    """A network from windows (N, bytes; zeros fill short ones) and the place of each one's language; every language is drawn alike often."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, width, seed)
    own = [np.flatnonzero(labels == k) for k in range(len(languages))]
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        which = rng.integers(0, len(languages), batch)
        rows = np.array([own[k][rng.integers(len(own[k]))] for k in which])
        x = windows[rows].T
        _, grads = net.gradients(x, which, _IS_LETTER[x])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def pooled(net: Network, texts: list[str], window: int = WINDOW, batch: int = BATCH) -> np.ndarray:
    """(N, C) mean probabilities over the letter positions of each text; zeros for a text without a letter."""
    blobs = [_bytes(t) for t in texts]
    parts = np.array([-(-len(b) // window) for b in blobs], dtype=np.int64)
    ends = np.cumsum(parts)
    cells = np.zeros((int(parts.sum()), window), dtype=np.uint8)
    for blob, end, k in zip(blobs, ends, parts):
        cells[end - k : end].reshape(-1)[: len(blob)] = np.frombuffer(blob, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), parts)
    sums, count = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    for s in range(0, len(cells), batch):
        x = np.ascontiguousarray(cells[s : s + batch].T)
        letter = _IS_LETTER[x]
        p = np.einsum("tcn,tn->nc", net.positions(net.states(x)), letter)
        np.add.at(sums, owner[s : s + batch], p)
        np.add.at(count, owner[s : s + batch], letter.sum(axis=0))
    return sums / np.maximum(count, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(lang, window)``: windows of about ``fit_rows`` different texts at most, each language with a like share, by the hash of the text.

    Rows without text or language are left out.
    """
    rows = rows.where("text is not null and lang is not null").select("lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return rows.sparkSession.createDataFrame([], "lang string, window binary")
    each = max(1, fit_rows // len(counts))
    most = {r["lang"]: (1 << 30) * each // max(each, r["n"]) for r in counts}
    share = F.create_map(*[F.lit(v) for pair in most.items() for v in pair])
    few = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang"))).dropDuplicates(["lang", "text"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"]):
                blob = _bytes(text)
                places = np.unique(np.linspace(0, max(0, len(blob) - FIT_BYTES), FIT_WINDOWS).astype(int))
                out += [(lang, blob[p : p + FIT_BYTES]) for p in places if _LETTER.search(text)]
            yield pd.DataFrame(out, columns=["lang", "window"])

    return few.mapInPandas(cut, "lang string, window binary")


def learn(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Network | None:
    """A network fitted on ``(text, lang)``; none where no row has both and a letter."""
    found = sorted(map(tuple, sample(rows, fit_rows).collect()))  # at most fit_rows texts in expectation, FIT_WINDOWS * FIT_BYTES bytes of each
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    place = {lang: i for i, lang in enumerate(languages)}
    windows = np.zeros((len(found), FIT_BYTES), dtype=np.uint8)
    for i, (_, w) in enumerate(found):
        windows[i, : len(w)] = np.frombuffer(bytes(w), dtype=np.uint8)
    return fit(windows, np.array([place[lang] for lang, _ in found]), languages)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` for each row: the language with the greatest mean probability, and that probability.

    Texts that are null, empty or have no letter, and all texts without a network, are ``und`` with score 0. Texts are read whole,
    however long, a few at a time. Repeated rows and null ids keep their row; of languages with equal probability the
    first by name stands; an empty table gives an empty result. Other columns aren't looked at, so their names can't clash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some kilobytes

    def some(texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and sent.value and _LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            p = pooled(sent.value, [texts[i] for i in known])
            for i, best, s in zip(known, p.argmax(axis=1), p.max(axis=1)):
                names[i], scores[i] = sent.value.languages[best], min(1.0, float(s))
        return names, scores

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            at = size = 0
            names, scores = [], []
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= 8 * BATCH * WINDOW or i + 1 == len(texts):
                    n, s = some(texts[at : i + 1])
                    names, scores, at, size = names + n, scores + s, i + 1, 0
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select(id_col, run(F.col(text_col)).alias("p")).select(id_col, "p.lang_pred", "p.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13_langid``: the language of every whole text of ``documents``, learned from rows that aren't held out."""
    docs = common.read(spark, sf_dir, "documents")
    net = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
