"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding: lower case, look-alike letters of other scripts to Latin ones, accents of Latin letters stay, and
digits or signs that stand for letters inside a word (``1d10t``, ``st@pid``) to those letters. A term is a word or
the beginning of a word; it counts only at the start of a word, one hit for each word (the heaviest). Hits inside
an exception phrase don't count. The weights of the hits, as a sum and for each thousand words, go through a
logistic curve.

The lexicon has a seed of common insults; terms, weights and the curve are fitted on labelled rows: every word
and word beginning is counted over toxic and clean rows (in Spark), and those that the log-likelihood ratio finds
far above chance join the lexicon with their log odds as weight.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common

# Common insults that start a lexicon without labels, and phrases in which they are harmless.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "sore loser", "not stupid", "not an idiot", "pond scum")
SEED_WEIGHT = 2.0
# Letters of other scripts that look like Latin ones.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ⅰ": "i", "ⅼ": "l", "ı": "i", "ſ": "s"}
#: Signs that stand for letters within a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")
_TABLE = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {0xFF21 + i: chr(0x61 + i) for i in range(26)}
_SUBS = str.maketrans(SUBSTITUTES)
#: A word in which only substitutable signs stand, at least one of them next to a letter.
_MASKED = re.compile(r"(?<![^\W_])(?=[013457@$]*[^\W\d_])(?:[^\W\d_]|[013457]|[@$](?=[^\W_]))*?(?:[013457@$](?=[^\W_])|(?<=[^\W\d_])[013457])(?:[^\W\d_]|[013457]|[@$](?=[^\W_]))*(?![^\W_])")
_SIGN = re.compile(r"[013457@$]")
_WORD = re.compile(r"[^\W\d_]+")

#: Labelled rows that the fit reads; of more, about so many are taken by the hash of their id. It bounds the lexicon too,
#: since a term needs three of these rows.
FIT_ROWS = 20_000
#: Word beginnings of these lengths are candidates beside whole words.
STEMS = (3, 4, 5, 6, 7)


def fold(text: str) -> str:
    """The text as it is matched."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    if _SIGN.search(text):
        text = _MASKED.sub(lambda m: m[0].translate(_SUBS), text)
    return text


def candidates(text: str) -> set[str]:
    """Words (closed by a space) and word beginnings of a text."""
    out = set()
    for w in set(_WORD.findall(fold(text))):
        out.add(w + " ")
        out.update(w[:n] for n in STEMS if n <= len(w))
    return out


@dataclass
class Lexicon:
    """``terms``: a word closed by a space, or the beginning of a word, with its weight. ``curve``: offset and
    slopes for ``log1p`` of the sum of weights and of the weights for each thousand words."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 2.5, 0.3)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term.rstrip(" "), (len(term.rstrip(" ")), weight, term.endswith(" "), False)) if term.rstrip(" ") not in a or not term.endswith(" ") else None
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0, True, True))
        a.make_automaton()
        return a


def load(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int, list[tuple[int, int]]]:
    """Sum of the weights of the hits of a text, its words, and the hits' spans in the folded text."""
    folded = fold(text)
    hits: dict[int, tuple[float, int]] = {}
    clear = []
    n = len(folded)
    if len(automaton):
        for end, (size, weight, closed, exempt) in automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha() or closed and end + 1 < n and folded[end + 1].isalpha():
                continue
            if exempt:
                clear.append((start, end))
            elif start not in hits or hits[start][0] < weight:
                hits[start] = (weight, end)
    if clear:
        clear.sort()
        starts, reach = [a for a, _ in clear], list(accumulate((b for _, b in clear), max))
        # A hit lies within a phrase if one that begins no later ends no earlier.
        hits = {s: x for s, x in hits.items() if not (k := bisect_right(starts, s)) or reach[k - 1] < x[1]}
    # A word that repeats (a line copied ten times) says little more than once.
    words: dict[str, float] = {}
    for s, (w, _) in hits.items():
        words[_WORD.match(folded, s)[0]] = w
    return sum(words.values()) + 0.1 * (len(hits) - len(words)), text.count(" ") + 1, sorted((s, x[1] + 1) for s, x in hits.items())


def features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000 * weight / words)


def curve_value(curve: tuple[float, float, float], weight: float, words: int) -> float:
    a, b = features(weight, words)
    z = curve[0] + curve[1] * a + curve[2] * b
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes below zero are held at zero."""
    design = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.array([-2.0, 1.0, 0.1]), np.diag([1e-3, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + ridge
        b = b - np.linalg.solve(h, design.T @ (p - y) + ridge @ b)
        b[1:] = np.clip(b[1:], 0.0, 8.0)
        b[0] = np.clip(b[0], -8.0, 4.0)
    return tuple(map(float, b))


def some_rows(rows: DataFrame, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` rows by the hash of their ``doc_id``, all if there are no more; no sort, no limit."""
    n = rows.count()
    if n <= fit_rows:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit((1 << 30) * fit_rows // n))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from rows ``(doc_id, text, toxic)``; null texts and labels are left out.

    Reads about ``fit_rows`` rows at most, by the hash of their id. Without a toxic or a clean row the seed
    is the lexicon.
    """
    rows = labelled.where("text is not null and toxic is not null").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample = some_rows(rows, fit_rows)
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    seed = {f"{t} ": SEED_WEIGHT for t in SEED}
    if not toxic or not clean:
        return Lexicon(seed)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                for c in candidates(text):
                    total.setdefault(c, [0, 0])[label] += 1
            if len(total) > 2_000_000:  # bounded memory: what is counted so far goes out as partial counts
                yield from _counted(total)
                total = {}
        yield from _counted(total)

    found = sample.mapInPandas(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # Log-likelihood ratio of the term's rows against the classes' shares.
    share, e = toxic / (toxic + clean), 1e-9
    n = F.col("t") + F.col("c")
    g = 2 * (F.col("t") * F.log((F.col("t") + e) / (n * share)) + F.col("c") * F.log((F.col("c") + e) / (n * (1 - share))))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    kept = found.select("term", "t", g.alias("g"), odds.alias("w")).where(f"t >= 3 and w >= 2.5 and g >= {20.0 + 2 * math.log(1 + (toxic + clean) / 1000)}")
    terms = dict(seed)
    rows = {r["term"]: (r["t"], r["w"]) for r in kept.collect()}
    best: dict[str, int] = {}  # most rows of any one longer term that begins so
    for term, (t, _) in rows.items():
        for k in STEMS:
            if k < len(term):
                best[term[:k]] = max(best.get(term[:k], 0), t)
    # A beginning stands for its words where it has clearly more rows than the best of them; else the word is the term.
    stems = {x for x, (t, _) in rows.items() if not x.endswith(" ") and t >= 1.3 * best.get(x, 0)}
    for term, (_, weight) in sorted(rows.items(), key=lambda r: (len(r[0]), r[0])):
        above = [terms[term[:k]] for k in STEMS if k < len(term) and term[:k] in terms]
        if (term in stems or term.endswith(" ")) and (not above or weight > max(above) + 1.0):
            terms[term] = max(weight, terms.get(term, 0.0))
    lexicon = Lexicon(terms)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon.automaton()
        for batch in batches:
            out = [features(*load(t, a)[:2]) for t in batch["text"]]
            yield pd.DataFrame({"a": [x[0] for x in out], "b": [x[1] for x in out], "toxic": batch["toxic"]})

    points = sample.mapInPandas(measure, "a double, b double, toxic int").toPandas()  # at most fit_rows rows of three numbers
    lexicon.curve = _fit_curve(points[["a", "b"]].to_numpy(), points["toxic"].to_numpy(dtype=float))
    return lexicon


def _counted(total: dict[str, list[int]]) -> Iterator[pd.DataFrame]:
    rows = [(term, *v) for term, v in total.items()]
    for i in range(0, len(rows), 50_000):
        yield pd.DataFrame(rows[i : i + 50_000], columns=["term", "clean", "toxic"])


def scorer(spark: SparkSession, lexicon: Lexicon):
    """A function of a text column: the score from 0 to 1. The lexicon's size is bounded by its fit."""
    sent = spark.sparkContext.broadcast(lexicon)
    built: list[ahocorasick.Automaton] = []

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not built:
            built.append(sent.value.automaton())
        for texts in batches:
            yield pd.Series([curve_value(sent.value.curve, *load(t, built[0])[:2]) for t in texts], dtype="float64")

    return lambda column: score(common.text_or_empty(column))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn from: labelled (the highest label where an id has several) and not held out."""
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = common.cut(some_rows(common.cut(own), FIT_ROWS))
    if few.count() <= 2 * FIT_ROWS:  # numbers only, so the texts needn't move
        few = F.broadcast(few)
    return docs.select("doc_id", "text").join(few, "doc_id")


def learn(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Lexicon:
    rows = labelled_rows(docs if docs is not None else common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return fit(common.cut(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_toxicity``: a score for every whole text of ``documents``, however long.

    Null texts score as empty ones, and these get the score of a text without hits. Repeated rows and null ids keep their row;
    an empty table gives an empty result. Columns other than doc_id and text aren't looked at, so their names can't clash.
    """
    docs = common.read(spark, sf_dir, "documents")
    score = scorer(spark, learn(spark, sf_dir))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
