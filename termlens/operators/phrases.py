"""Whole terms in texts for a vocabulary table of any size, with phrases and symbols.

Text and terms are rows of tokens: lower-case runs of ASCII letters, digits and underscores, or one other character. A term stands in a
text where its tokens stand there one after the other; at an end that is a symbol no word may touch it. So finding terms is a
join of the text's token runs with the vocabulary by their hash, and only runs that can be a term need to be made:

- a table of ``OPENINGS`` entries has, for the hash of a first token, the lengths of the terms that begin so;
- a Bloom filter of all terms (about 16 bits a term, ``MAX_BITS`` at most) drops nearly all other runs.

Both are built by the executors, have a fixed bound, and only save work: the join decides. A text is scanned once, without a shuffle;
what moves is a row for each distinct term of a text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.sources import stage

OPENINGS = 1 << 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26
#: Runs that leave a task at a time.
SENT = 20_000
#: Bit of a table entry that stands for terms of this many tokens or more; their lengths are listed.
MANY = 62
_TOKEN = re.compile(r"[a-z0-9_]+|[^a-z0-9_]")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _opening(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) % OPENINGS


def _places(term: str, bits: int) -> tuple[int, int, int]:
    h = xxhash.xxh3_64_intdigest(term, 1)
    return h % bits, (h >> 21) % bits, (h >> 42) % bits


class Filter:
    """The two tables; ``runs`` gives the token runs of a text that they let through, with their places."""

    def __init__(self, openings: dict[int, int], long: list[int], words: np.ndarray):
        self.openings, self.long, self.words = openings, long, words
        self.raw, self.bits = words.astype("<u8").tobytes(), 64 * len(words)
        self.lengths = lru_cache(1 << 16)(self._lengths)

    def __reduce__(self):
        return Filter, (self.openings, self.long, self.words)

    def _lengths(self, token: str) -> list[int]:
        """Lengths of the terms that may begin with a token, ascending."""
        mask = self.openings.get(_opening(token), 0)
        return [n for n in range(1, MANY) if mask >> n & 1] + (self.long if mask >> MANY & 1 else [])

    def may_be(self, term: str) -> bool:
        raw, (a, b, c) = self.raw, _places(term, self.bits)
        return bool(raw[a >> 3] >> (a & 7) & 1 and raw[b >> 3] >> (b & 7) & 1 and raw[c >> 3] >> (c & 7) & 1)

    def runs(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """``{run: [(first token, after the last), ..]}``."""
        t = tokens(text)
        found: dict[str, list[tuple[int, int]]] = {}
        other: set[str] = set()
        for i, token in enumerate(t):
            lengths = self.lengths(token)
            if not lengths or i and token[0] not in _WORD and t[i - 1][0] in _WORD:
                continue
            for n in lengths:
                end = i + n
                if end > len(t):
                    break
                if end < len(t) and t[end][0] in _WORD and t[end - 1][0] not in _WORD:
                    continue
                run = token if n == 1 else "".join(t[i:end])
                if run in found:
                    found[run].append((i, end))
                elif run not in other:
                    if self.may_be(run):
                        found[run] = [(i, end)]
                    elif len(other) < 100_000:
                        other.add(run)
        return found


def build(terms: DataFrame) -> Filter:
    """The tables of a frame of distinct normal forms in ``term``."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * terms.count()).bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for term in batch["term"]:
                t = tokens(term)
                out.append((0, _opening(t[0]), 1 << min(len(t), MANY)))
                out += [(1, p >> 6, (1 << (p & 63)) - (1 << 64) * ((p & 63) == 63)) for p in _places("".join(t), bits)]
                if len(t) >= MANY:
                    out.append((2, len(t), 0))
            yield pd.DataFrame(out, columns=["kind", "at", "mask"])

    words, openings, long = np.zeros(bits // 64, dtype=np.uint64), {}, []
    # At most OPENINGS + MAX_BITS / 64 rows, and one for each length of MANY tokens or more.
    for r in terms.mapInPandas(count, "kind int, at int, mask long").groupBy("kind", "at").agg(F.bit_or("mask").alias("mask")).collect():
        if r["kind"] == 0:
            openings[r["at"]] = r["mask"]
        elif r["kind"] == 1:
            words[r["at"]] = r["mask"] & ((1 << 64) - 1)
        else:
            long.append(r["at"])
    return Filter(openings, sorted(long), words)


def _sent(batches: Iterator[pa.RecordBatch], schema: pa.Schema, made) -> Iterator[pa.RecordBatch]:
    """The rows that ``made`` gives for each row, about ``SENT`` at a time: a text is a Python object only while it is looked at."""
    out: list[list] = [[] for _ in schema]
    for batch in batches:
        for i in range(batch.num_rows):
            for row in made(*[c[i].as_py() for c in batch.columns]):
                for column, x in zip(out, row):
                    column.append(x)
            if len(out[0]) >= SENT:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[] for _ in schema]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def _chosen(spans: Iterator[tuple[int, int, str]]) -> list[str]:
    """Distinct terms of the spans that a reader takes who goes from left to right, the longest at each place."""
    out, reach = {}, 0
    for start, end, term in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= reach:
            out[term], reach = None, end
    return list(out)


def extract(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text", term: str = "term", mode: str = "all", keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``(key, *keep, term)``, terms in normal form.

    ``mode="all"`` reports every term on its own, ``"longest"`` those that don't overlap: leftmost first, the longest at a place.
    Null and empty texts and terms have no match; rows with one key are looked at one by one; texts and terms may be of any length; a term's
    single spaces are single spaces in the text. Empty tables give an empty result.
    """
    terms = vocabulary.select(tx.normalize(F.col(term)).alias("term")).where("term <> ''").distinct()
    sent = docs.sparkSession.sparkContext.broadcast(build(terms))  # bounded tables
    rows = docs.where(F.col(text).isNotNull())
    who = [F.col(c) for c in (key, *keep)]
    if mode == "all":

        @F.pandas_udf("array<string>")
        def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([list(sent.value.runs(t)) for t in batch])

        found = rows.select(*who, F.explode(runs(F.col(text))).alias("term")).distinct()
        return found.join(terms, "term").select(*who, "term")

    # A text's keys go with its spans as one structure, so that they may have any type.
    runs_kind = pa.schema([("row", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("starts", pa.binary())])
    terms_kind = pa.schema([("row", pa.int64()), ("term", pa.string())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(batches, runs_kind, lambda row, t: ((row, run, at[0][1] - at[0][0], array("i", [a for a, _ in at]).tobytes()) for run, at in sent.value.runs(t).items()))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(batches, terms_kind, lambda row, group: ((row, t) for t in _chosen((a, a + s["n"], s["term"]) for s in group for a in array("i", s["starts"]))))

    placed = stage.written(rows.select(*who, F.col(text).alias("__text")).withColumn("__row", F.monotonically_increasing_id()))
    found = placed.select("__row", "__text").mapInArrow(spans, "row long, term string, n int, starts binary")
    true = found.join(terms, "term").groupBy("row").agg(F.collect_list(F.struct("term", "n", "starts")).alias("spans"))  # of one text
    chosen = true.mapInArrow(choose, "row long, term string")
    return placed.select("__row", *[c for c in (key, *keep)]).join(chosen.withColumnRenamed("row", "__row").withColumnRenamed("term", "__term"), "__row").select(*who, F.col("__term").alias("term")).distinct()
