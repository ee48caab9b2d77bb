"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least (by hash) of its s-mers is the first or the last one.
Whether a k-mer is chosen depends on nothing but itself, so equal passages choose equal anchors wherever they
stand. A fingerprint keeps the ``ANCHORS`` syncmers with the least hashes, each with the place where it first
stands. The likeness of two fingerprints is the share of the least anchors of both together that they have in
common in the same order (a longest increasing run of places).

A text's edited form needs the document that follows it. Documents are dealt into ranges of doc_id, sorted,
and read with one row held back; the first document of each range goes to the range before it as well.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common
from termlens.llm.hashing import BASE, U, codes, letters, mix

K, S, ANCHORS = 12, 4, 96
_FIRST = -(2**63)
_B4 = U(pow(int(BASE), 4, 2**64))


def syncmers(c: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of a sequence of code points."""
    if len(c) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    r, n = letters(c), len(c) - s + 1
    poly = r[:n].copy()
    for i in range(1, s):
        poly *= BASE
        poly += r[i : i + n]
    order = ((poly ^ (poly >> U(31))) * mix(np.array([7], U))[0] >> U(32)).astype(np.uint32)
    least, done, w = order, 1, k - s + 1
    while 2 * done <= w:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < w:
        least = np.minimum(least[: len(order) - w + 1], least[w - done : len(order) - done + 1])
    m = len(least)
    at = np.flatnonzero((least == order[:m]) | (least == order[w - 1 : w - 1 + m]))
    # A k-mer's hash from its s-mers; the last one overlaps where s doesn't divide k.
    value = poly[at]
    for step in [*range(s, k - s, s), k - s]:
        value = value * _B4 + poly[at + step]
    return at, (mix(value) >> U(32)).astype(np.uint32)


def anchors(text: str, c: np.ndarray | None = None) -> dict[int, int]:
    """Hash -> first place, in order of hash. A text without a syncmer is one anchor, the empty text none."""
    if not text:
        return {}
    at, value = syncmers(codes(text) if c is None else c)
    if not len(at):
        return {int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()): 0}
    if len(value) > 8 * ANCHORS:
        # The least hashes are among those up to the ANCHORS-th distinct one; repeats may need a wider cut.
        width = 2 * ANCHORS
        while True:
            bound = np.partition(value, min(width, len(value) - 1))[min(width, len(value) - 1)]
            keep = value <= bound
            if width >= len(value) or len(np.unique(value[keep])) >= ANCHORS:
                break
            width *= 4
        at, value = at[keep], value[keep]
    distinct, first = np.unique(value, return_index=True)
    return dict(zip(distinct[:ANCHORS].tolist(), at[first][:ANCHORS].tolist()))


def render(found: dict[int, int]) -> str:
    return ",".join(f"{h:08x}{p:x}" for h, p in found.items())


def parse(fingerprint: str) -> dict[int, int]:
    return {int(x[:8], 16): int(x[8:], 16) for x in fingerprint.split(",")} if fingerprint else {}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """0 to 1; 1 for equal fingerprints, two empty ones too."""
    if a == b:
        return 1.0
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    union = sorted(a.keys() | b.keys())[:ANCHORS]
    last = union[-1]
    places = [b[h] for h in sorted((h for h in both if h <= last), key=a.__getitem__)]
    run: list[int] = []
    for p in places:
        i = bisect_left(run, p)
        run[i : i + 1] = [p]
    return len(run) / len(union)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of a text replaced by the first as many code points of another."""
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = held = None
    for batch in batches:
        out = []
        for p, extra, row_id, text in zip(batch["part"], batch["extra"], batch["id"], batch["text"]):
            if p != part:
                part, held = p, None
            own = anchors(text) if held is None or held[1] != text else held[2]
            if held is not None:
                before, fore = held[1], held[2]
                new = edited(before, text)
                other = anchors(new) if new != before else fore
                out.append((held[0], len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), render(fore), render(other), likeness(fore, other), likeness(fore, own)))
            held = None if extra else (row_id, text, own)
        yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"id": "Int64"})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for each row.

    The next document is the next row by id, then text (null ids first, as one id); after the last comes the
    first, so a single row follows itself. Null texts are empty. An empty text has the empty fingerprint,
    which is like another empty one only. Repeated rows keep their row each and follow one another; texts are read whole,
    however long; an empty table gives an empty result. Other columns aren't looked at, so their names can't clash.
    """
    spark = docs.sparkSession
    n = common.partitions(spark) * 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    key = F.coalesce(F.col("id"), F.lit(_FIRST))
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)
    rows = rows.withColumn("part", part)
    firsts = sorted((r["part"], r["k"]) for r in rows.groupBy("part").agg(F.min(key).alias("k")).collect())
    if not firsts:
        return rows.select("id", "text").mapInPandas(_pairs, _OUT).withColumnRenamed("id", id_col)
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    goes = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    heads = rows.where(key.isin([k for _, k in firsts])).groupBy("part").agg(F.min(F.struct(key.alias("k"), "text")).alias("m"))
    heads = heads.select(goes[F.col("part")].alias("part"), F.lit(True).alias("extra"), F.lit(None).cast("long").alias("id"), F.col("m.text").alias("text"))
    dealt = rows.select("part", F.lit(False).alias("extra"), "id", "text").unionByName(heads).repartition(n, "part")
    out = dealt.sortWithinPartitions("part", "extra", F.col("id").asc_nulls_first(), "text").mapInPandas(_pairs, _OUT)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_syncmers``: fingerprints of every whole text of ``documents`` and of its edited form."""
    return fingerprints(common.read(spark, sf_dir, "documents"))
