"""Importance resampling towards a target's word distribution, over hashed word runs.

Features are all runs of 1 to ``n`` consecutive words, hashed to ``BUCKETS`` buckets by CRC-32. A CRC can be carried on: the
state of a run is the state of the run one word shorter, fed with a space and the next word. So one scan of a text keeps a ring
of the states of the last ``n`` starts, carries each on by a space and the word, and gives a bucket for each; no run is ever
put together as text.

Two passes over the corpus. The first counts the buckets of all documents and of the target: a task keeps one vector of
``BUCKETS`` counts and sends its non-zero places. The second scores each document by the mean gain of its features plus
Gumbel noise from a hash of its id, so that the highest scores are a draw without replacement by importance weight. Ranks come
from counts by score: a score is a whole number within fixed bounds, so there are some 100,000 at most, whatever the input.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlens.llm import common

BUCKETS, RUN, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
#: Buckets of a text that are held before they are added up.
CHUNK = 1 << 16
#: Words in UTF-8: digits, lower-case letters and all that isn't ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> Iterator[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8."""
    for m in _WORD.finditer(text.encode("utf-8", "surrogatepass").lower()):
        yield m[0]


def buckets(text: str, n: int = RUN, size: int = BUCKETS) -> Iterator[array]:
    """The buckets of all word runs of a text, in pieces of about ``CHUNK``; one scan with a ring of ``n`` states."""
    out = array("I")
    ring: list[int] = []  # states of the runs that end at the last word, the longest first
    for w in words(text):
        spaced = b" " + w
        if len(ring) == n:
            del ring[0]
        ring = [crc32(spaced, state) for state in ring]
        ring.append(crc32(w))
        out.extend(ring)
        if len(out) >= CHUNK:
            yield array("I", [x % size for x in out])
            out = array("I")
    if out:
        yield array("I", [x % size for x in out])


def counts(texts: DataFrame, column: str = "text", n: int = RUN, size: int = BUCKETS) -> np.ndarray:
    """How many word runs of all texts fall into each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                for piece in buckets(text, n, size):
                    total += np.bincount(np.frombuffer(piece, dtype=np.uint32), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    rows = texts.select(F.col(column).alias("text")).where("text is not null").mapInPandas(count, "bucket int, n long")
    out = np.zeros(size, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares of target and corpus, rounded down."""
    S, T, size = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float(t + 1) * float(S + size) / (float(s + 1) * float(T + size))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate from the hash of ``seed:doc_id``, rounded down; a null id counts as no digits."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int = RUN, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of each row."""
    size = len(gain)
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    @F.pandas_udf("n_words long, n_features long, weight long, score long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for ids, texts in batches:
            out = []
            for i, text in zip(ids, texts):
                features = total = 0
                for piece in buckets(text, n, size):
                    features += len(piece)
                    total += int(g[np.frombuffer(piece, dtype=np.uint32)].sum())
                weight = total // features if features else 0
                # All runs of k words of w words are w - k + 1, so the features tell the words.
                w = features if features < 2 or n == 1 else _words_of(features, n)
                out.append((w, features, weight, weight + noise(None if i == "" else i, seed)))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight", "score"])

    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", run(named, common.text_or_empty("text")).alias("x")).select("doc_id", "x.*")


def _words_of(features: int, n: int) -> int:
    """The number of words whose runs of 1 to ``n`` words are so many."""
    w = next((w for w in range(1, n) if w * (w + 1) // 2 == features), None)
    return w if w is not None else (features + n * (n - 1) // 2) // n


def resample(docs: DataFrame, target: DataFrame, n: int = RUN, size: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for each row of ``docs``: a draw without replacement of ``percent`` of the rows
    with ``least`` words or more, by their likeness to ``target`` (a frame with ``text``); rows that aren't drawn have no rank.

    Null and empty texts have no features and weight 0; null ids draw by the hash of an empty id. Equal scores go by the smaller id,
    null ids first; rows with equal scores and ids are ranked in any order, which their columns don't show. Texts are read whole, however
    long. An empty table gives an empty result, an empty target weighs by the corpus alone. Other columns aren't looked at, so
    their names can't clash.
    """
    gain = gains(counts(docs, "text", n, size), counts(target, "text", n, size))
    return draw(common.written(scored(docs.select("doc_id", "text"), gain, n, seed)), least, percent)


def draw(rows: DataFrame, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """`scored` rows with the ``rank`` of those that are drawn; the frame is read several times.

    One row for each score is counted: noise lies between -3,200 and 23,000, a gain between the logs of 1 and of all features.
    """
    eligible = F.col("n_words") >= least
    by_score = rows.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    by_score = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    drawn = by_score.select("score", "before", F.floor(F.col("all") * percent / 100).alias("k")).where("before < k")
    last = drawn.agg(F.min("score").alias("s")).first()["s"]
    columns = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*columns, no_rank)
    high = eligible & (F.col("score") >= last)
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first()))
    ranked = rows.where(high).join(drawn, "score").withColumn("rank", rank)
    ranked = ranked.select(*columns, F.when(F.col("rank") <= F.col("k"), F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(rows.where(~high).select(*columns, no_rank))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_resampling``: a quarter of ``documents`` of 20 words or more, drawn towards the words of ``benchmark``."""
    return resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
