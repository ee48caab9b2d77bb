"""The nearest vocabulary term by matching blocks, as a filtered join of two tables of any size.

The likeness of two terms is ``2 m / (la + lb)``: the characters of their matching blocks against their lengths. No more characters
can match than the two have in common, counted with repeats. So a pair can reach a cutoff only if its lengths are near
enough and it shares ``m`` *tokens*, where a token is a character with its number among its equals (the second ``e``).

Sets that share ``m`` tokens share the first ``d`` of these tokens, in any fixed order, within their first ``size - m + d`` tokens.
With the rarest tokens first, each term is indexed under the pairs (``d = 2``) of such a prefix, and pairs of terms that meet under a key
are the candidates; none that reaches the cutoff is missed. A 64-bit sketch of the tokens drops most candidates within the join,
since terms can't differ in more sketch bits than in tokens. Only what is left is compared.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that are ordered by how many vocabulary terms have them; all others count as rarer.
ORDERED = 4096
#: Pairs of terms that are as long together have single tokens as keys: long prefixes have too many pairs.
LONG = 128
_MASK = (1 << 64) - 1
_KEYS = "key long, sketch long, size int, term string"


def least_common(cutoff: float, sizes: int) -> int:
    """The fewest common characters with which two terms of together ``sizes`` characters reach the cutoff."""
    m = max(1, math.ceil(cutoff * sizes / 2) - 1)
    while 2.0 * m / sizes < cutoff:
        m += 1
    return m


def tokens(term: str) -> list[tuple[str, int]]:
    seen: Counter = Counter()
    out = []
    for c in term:
        out.append((c, seen[c]))
        seen[c] += 1
    return out


def _needs(own: list[int], others: list[int], cutoff: float) -> dict[int, list[tuple[int, int]]]:
    """For each length: ``(d, m)``, how many tokens make a key and the fewest that a pair has in common, for partners that are there."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a in own:
        least: dict[int, int] = {}
        for b in others:
            m = least_common(cutoff, a + b)
            if m <= min(a, b):
                d = 2 if m >= 2 and a + b < LONG else 1
                least[d] = min(m, least.get(d, m))
        if least:
            out[a] = sorted(least.items())
    return out


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(term: str, needs: list[tuple[int, int]], ranks: dict[tuple[str, int], int]) -> tuple[set[int], int]:
    """The keys of a term and the sketch of its tokens."""
    marked = sorted(ranks.get(t, -((t[1] << 21) + ord(t[0]) + 1)) for t in tokens(term))
    sketch = 0
    for r in marked:
        sketch |= 1 << (_mixed(r & _MASK) & 63)
    found = set()
    for d, m in needs:
        prefix = marked[: len(marked) - m + d]
        for chosen in combinations(prefix, d):
            h = d
            for r in chosen:
                h = _mixed((h * 0x9E3779B97F4A7C15 + r) & _MASK)
            found.add(_signed(h))
    return found, _signed(sketch)


def _indexed(terms: DataFrame, needs: dict[int, list[tuple[int, int]]], ranks: dict[tuple[str, int], int]) -> DataFrame:
    """``(key, sketch, size, term)``: a row for each key of each term that has a partner of a fitting length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for term in batch["term"]:
                if len(term) in needs:
                    found, sketch = keys(term, needs[len(term)], ranks)
                    out += [(k, sketch, len(term), term) for k in found]
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=["key", "sketch", "size", "term"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "sketch", "size", "term"])

    return terms.mapInPandas(run, _KEYS)


def _ranks(vocabulary: DataFrame) -> dict[tuple[str, int], int]:
    """A number for each of the most frequent tokens, the most frequent highest."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for term in batch["term"]:
                total.update(tokens(term))
            if len(total) > 200_000:
                yield pd.DataFrame([(*t, n) for t, n in total.items()], columns=["c", "k", "n"])
                total.clear()
        yield pd.DataFrame([(*t, n) for t, n in total.items()], columns=["c", "k", "n"])

    rows = vocabulary.mapInPandas(count, "c string, k int, n long").groupBy("c", "k").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "c", "k").limit(ORDERED).collect()
    return {(r["c"], r["k"]): len(top) - i for i, r in enumerate(top)}


def _meeting(asked: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """``(a, b)``: `candidates`, some of them several times."""
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff is above 0 and at most 1")
    sizes = [sorted(r[0] for r in t.select(F.length("term")).distinct().collect()) for t in (asked, vocabulary)]  # one number a length
    ranks = _ranks(vocabulary)
    left = _indexed(asked, _needs(sizes[0], sizes[1], cutoff), ranks).select("key", F.col("sketch").alias("sa"), F.col("size").alias("la"), F.col("term").alias("a"))
    right = _indexed(vocabulary, _needs(sizes[1], sizes[0], cutoff), ranks).select("key", F.col("sketch").alias("sb"), F.col("size").alias("lb"), F.col("term").alias("b"))
    both = F.col("la") + F.col("lb")
    common = F.ceil(both * (cutoff / 2) - 1e-6)
    near = (F.least("la", "lb") >= common) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= both - 2 * common)
    return left.join(right, "key").where(near).select("a", "b")


def candidates(asked: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """Distinct ``(a, b)``: of ``asked`` and ``vocabulary`` (frames of distinct, filled strings in ``term``) all pairs whose lengths and
    common characters let them reach the cutoff, and few others."""
    return _meeting(asked, vocabulary, cutoff).distinct()


class Asked:
    """One asked term against vocabulary terms, the best so far kept.

    Matching blocks are a common subsequence, so the longest one bounds them; its length takes a few machine words a character. Only a
    pair whose bound can beat the best is compared by blocks.
    """

    def __init__(self, term: str, cutoff: float):
        self.term, self.ratio, self.best = term, cutoff, ""
        self.full = (1 << len(term)) - 1
        self.places: dict[str, int] = {}
        for i, c in enumerate(term):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.matcher = difflib.SequenceMatcher()
        self.matcher.set_seq2(term)

    def common(self, other: str) -> int:
        """The length of the longest common subsequence."""
        v, full, places = self.full, self.full, self.places
        for c in other:
            if m := places.get(c):
                u = v & m
                v = (v + u | v - u) & full
        return len(self.term) - v.bit_count()

    def meet(self, other: str) -> None:
        bound = 2.0 * self.common(other) / (len(self.term) + len(other))
        if bound > self.ratio or bound == self.ratio and other > self.best:
            self.matcher.set_seq1(other)
            ratio = self.matcher.ratio()
            if ratio > self.ratio or ratio == self.ratio and other > self.best:
                self.ratio, self.best = ratio, other


def nearest(asked: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """``(a, b, ratio)``: for each asked term its nearest vocabulary term at or above the cutoff; of equally near ones the last by name.

    Both frames hold distinct strings in ``term``; null and empty ones meet nothing. Neither side goes through the driver or is
    copied to all tasks; terms may have any length. Empty tables give an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for batch in batches:
            out = []
            for a, b in zip(batch["a"], batch["b"]):
                if now is None or a != now.term:
                    if now is not None and now.best:
                        out.append((now.term, now.best, now.ratio))
                    now, last = Asked(a, cutoff), None
                if b != last:  # pairs that met under several keys follow one another
                    now.meet(b)
                    last = b
            yield pd.DataFrame(out, columns=["a", "b", "ratio"])
        if now is not None and now.best:
            yield pd.DataFrame([(now.term, now.best, now.ratio)], columns=["a", "b", "ratio"])

    filled = [t.select("term").where("term <> ''") for t in (asked, vocabulary)]
    n = 4 * max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = _meeting(*filled, cutoff).repartition(n, "a").sortWithinPartitions("a", "b")
    return pairs.mapInPandas(run, "a string, b string, ratio double")
