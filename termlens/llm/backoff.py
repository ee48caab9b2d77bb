"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

For a word w after v after u: ``c(uvw) / c(uv)`` if the trigram occurs ``LEAST`` times or more in the corpus, else
``0.4 c(vw) / c(v)`` if the bigram does, else ``0.16 c(w) / N``. A document's score is the sum of their logarithms
(base 10). With one occurrence allowed, every document would vouch for itself.

Counting and scoring are two joins on hash partitions. Documents are dealt into blocks. A block explodes its
n-grams and sends, for each order and hash partition, its distinct n-grams and how often each occurs, packed (a
relation of n-grams with one row for each block and partition instead of one for each n-gram). A partition adds
up the counts of all blocks, which makes its part of the count table, and joins it back: each block gets the
counts for what it asked. The block joins them to its exploded n-grams and sums per document. Words and pairs go
first; a longer n-gram is asked for only where both its parts occur ``LEAST`` times, as it can't occur more often
than they do. A frequent n-gram is one entry for a block, so no key is hot; numbers of blocks and partitions follow
the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common
from termlens.llm.dartminhash import word_hashes
from termlens.llm.hashing import BASE, U, mix

ORDER, LEAST, BACKOFF = 3, 2, 0.4
#: Characters of a block of documents, and of the corpus for each hash partition.
BLOCK_CHARS, PART_CHARS = 6_000_000, 16_000_000
#: Bits of an n-gram's hash that are sent beside its partition.
BITS = 48


def grams(words: list[np.ndarray], order: int) -> list[np.ndarray]:
    """For n = 1 .. order, the hashes of the n-grams that end at each word of a block's documents; 0 where a
    document has no n words up to there."""
    flat = np.concatenate([np.zeros(0, U), *words])
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, h = [], flat
    for n in range(1, order + 1):
        if n > 1:
            h = np.concatenate([np.zeros(1, U), h[:-1]])[: len(flat)] * BASE + flat
        g = mix(h + U(n))
        g[g == 0] = 1
        out.append(np.where(place >= n - 1, g, U(0)))
    return out


def parts_of(distinct: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash partitions that sorted hashes meet, and where each begins (and the last one ends). No step for the others."""
    part = ((distinct >> U(32)) * U(parts)) >> U(32)
    first = np.flatnonzero(np.diff(part, prepend=U(parts)))
    return part[first].astype(np.int64), np.append(first, len(distinct))


def low_of(part: int, parts: int) -> int:
    """The least hash of a partition."""
    return -(-(part << 32) // parts) << 32


def pack(values: np.ndarray, low: int, width: int) -> bytes:
    """Sorted hashes of one partition (from ``low``, ``width`` wide): BITS bits of each, as gaps of five bytes or
    else as six bytes."""
    x = (values - U(low)) >> U(max(0, width.bit_length() - BITS))
    gaps = np.diff(x, prepend=U(0))
    size = 5 if not len(gaps) or int(gaps.max()) < 1 << 40 else 6
    return bytes([size]) + (gaps if size == 5 else x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    size = blob[0]
    rows = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, size)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :size] = rows
    x = wide.view("<u8").ravel()
    return np.cumsum(x, dtype=U) if size == 5 else x


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte for each count; those of 255 and more follow at the end in eight."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    large = counts == 255
    if large.any():
        counts[large] = np.frombuffer(blob, "<u8", offset=n).astype(np.int64)
    return counts


def _rows(g: np.ndarray, n: int, block, parts: int) -> pd.DataFrame:
    """A block's distinct n-grams of one order and their counts, packed by partition."""
    distinct, counts = np.unique(g[g != 0], return_counts=True)
    met, at = parts_of(distinct, parts)
    rows = [(p, n, block, pack(distinct[a:b], low_of(p, parts), low_of(p + 1, parts) - low_of(p, parts)), pack_counts(counts[a:b])) for p, a, b in zip(met.tolist(), at, at[1:])]
    return pd.DataFrame(rows, columns=["part", "n", "block", "hashes", "counts"])


def _ask(parts: int):
    """Sorted rows (block, ..., text) -> the block's words and pairs of words."""

    def emit(block, texts: list[str]) -> Iterator[pd.DataFrame]:
        for n, g in enumerate(grams([word_hashes(t) for t in texts], min(2, ORDER)), 1):
            yield _rows(g, n, block, parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, texts = None, []
        for batch in batches:
            for block, text in zip(batch["block"], batch["text"]):  # ids come along: the exchange is then the other branch's
                if block != held:
                    if texts:
                        yield from emit(held, texts)
                    held, texts = block, []
                texts.append(text)
        if texts:
            yield from emit(held, texts)

    return run


def _before(x: np.ndarray) -> np.ndarray:
    """What stands one place earlier in the block."""
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])[: len(x)]


def _seen(gs: list[np.ndarray], counts: pd.DataFrame, parts: int, least: int) -> list[np.ndarray]:
    """The corpus's counts of the n-grams at each place, order by order; of 3 and more words 0 where a part is rarer
    than ``least``, since the whole is then too and wasn't asked for."""
    known = {(n, p): c for n, p, c in zip(counts["n"], counts["part"], counts["counts"])}
    out: list[np.ndarray] = []
    for n, g in enumerate(gs, 1):
        if n > 2:
            g = _frequent(g, out[-1], least)
        distinct, at = np.unique(g, return_inverse=True)
        skip = int(len(distinct) > 0 and distinct[0] == 0)
        met, ends = parts_of(distinct[skip:], parts)
        full = [unpack_counts(known[n, p], int(b - a)) for p, a, b in zip(met.tolist(), ends, ends[1:])]
        out.append(np.concatenate([np.zeros(skip, np.int64), *full])[at])
    return out


def _frequent(g: np.ndarray, parts_seen: np.ndarray, least: int) -> np.ndarray:
    """The n-grams whose two parts (one word shorter) occur often enough, else 0."""
    return np.where((parts_seen >= least) & (_before(parts_seen) >= least), g, U(0))


def _ask_more(parts: int, n: int, least: int):
    """A block's n-grams of three and more words whose parts are frequent."""

    def run(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return _rows(np.zeros(0, U), n, 0, parts)
        gs = grams([word_hashes(t) for t in docs["text"]], n)
        return _rows(_frequent(gs[-1], _seen(gs[:-1], counts, parts, least)[-1], least), n, docs["block"].iloc[0], parts)

    return run


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (part, n, block, hashes, counts): the part's count table, joined back to each block's n-grams."""

    def answer(key, rows: list[tuple]) -> pd.DataFrame:
        asked = [unpack(h) for _, h, _ in rows]
        counts = np.concatenate([unpack_counts(c, len(a)) for (_, _, c), a in zip(rows, asked)])
        table, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(table)).astype(np.int64)[at]
        ends = np.cumsum([len(a) for a in asked])
        return pd.DataFrame([(b, key[1], key[0], pack_counts(total[e - len(a) : e])) for (b, _, _), a, e in zip(rows, asked, ends)], columns=["block", "n", "part", "counts"])

    held, rows = None, []
    for batch in batches:
        for part, n, *row in zip(*(batch[c] for c in ("part", "n", "block", "hashes", "counts"))):
            if (part, n) != held:
                if rows:
                    yield answer(held, rows)
                held, rows = (part, n), []
            rows.append(tuple(row))
    if rows:
        yield answer(held, rows)


def _score(parts: int, order: int, least: int, total: int):
    back = math.log10(BACKOFF)

    def run(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        words = [word_hashes(t) for t in docs["text"]]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        seen = _seen(grams(words, order), counts, parts, least)
        value = np.log10(np.maximum(seen[0], 1)) - math.log10(max(1, total)) + back * (order - 1)
        for n in range(2, order + 1):
            context = _before(seen[n - 2])
            hit = seen[n - 1] >= least
            # The best order comes last and stands.
            value = np.where(hit, np.log10(np.maximum(seen[n - 1], 1)) - np.log10(np.maximum(context, 1)) + back * (order - n), value)
        ends = np.cumsum(lengths)
        score = [float(np.sum(value[e - k : e])) for e, k in zip(ends, lengths)]
        return pd.DataFrame({"id": docs["id"], "n_words": lengths, "score": score})

    return run


def scores(docs: DataFrame, order: int = ORDER, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """``(id, n_words, score, mean)`` for each row: the sum and the mean of its words' log10 scores.

    Words are maximal runs of other than white space. Null and empty texts have score 0 and a null mean. Null
    ids and repeated rows keep their row and count in the corpus each time; a text is scored whole, however long;
    other columns aren't looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(common.WORD))).alias("words")).first()
    chars, total = size["chars"] or 0, size["words"] or 0
    blocks, parts = 1 + chars // block_chars, 1 + chars // part_chars
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(common.partitions(spark), "block")
    n_parts, asked_schema = common.partitions(spark), "part int, n int, block long, hashes binary, counts binary"

    def counted(asked: DataFrame) -> DataFrame:
        return asked.repartition(n_parts, "part").sortWithinPartitions("part", "n").mapInPandas(_count, "block long, n int, part int, counts binary")

    counts = counted(dealt.sortWithinPartitions("block").mapInPandas(_ask(parts), asked_schema))
    for n in range(3, order + 1):
        asked = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(_ask_more(parts, n, least), asked_schema)
        counts = counts.unionByName(counted(asked))
    out = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(_score(parts, order, least, total), "id long, n_words long, score double")
    return out.select(F.col("id").alias(id_col), "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_backoff``: the score of every whole text of ``documents`` under trigrams of all of them."""
    return scores(common.read(spark, sf_dir, "documents"))
