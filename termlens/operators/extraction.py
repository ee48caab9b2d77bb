"""Finding vocabulary terms in texts.

``mode="all"`` reports every term on its own, also inside another one. ``mode="longest"`` reads a text once from
left to right and takes the longest term at each place, so terms don't overlap.

A vocabulary in a table goes to `phrases`. One that is a list is split when the plan is made. Terms of one word become a join of the text's words with the
vocabulary, terms of several plain words a join with the text's word runs of that length; only terms with other
characters (``C++``, ``.NET``) and, in longest mode, terms that share a word with another one, go through a pattern.
The join's vocabulary side is whatever size it is: Catalyst and AQE broadcast it only below their threshold.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import phrases
from termlens.sources import numbering

_PLAIN = re.compile(r"[a-z0-9_]+(?: [a-z0-9_]+)*")


def split_vocabulary(terms: list[str], mode: str) -> tuple[list[str], list[str]]:
    """(terms for the word join, terms for the pattern), normalized and distinct."""
    terms = sorted({t for t in map(tx.normalize_py, terms) if t})
    plain = [t for t in terms if _PLAIN.fullmatch(t)]
    rest = [t for t in terms if not _PLAIN.fullmatch(t)]
    if mode == "all":
        return plain, rest
    uses = Counter(w for t in terms for w in re.findall(r"[a-z0-9_]+", t))
    tangled = [t for t in plain if any(uses[w] > 1 for w in t.split(" "))]
    return [t for t in plain if t not in set(tangled)], tangled + rest


def _word_matches(docs: DataFrame, key: str, text: str, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, term) for plain terms. A run of words is joined by single spaces in the text or it is no match."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    parts = []
    for n in lengths:
        if n == 1:
            found = F.array_distinct(tx.words(F.col(text)))
        else:
            runs = F.regexp_extract_all(lower, F.lit(r"[a-z0-9_]++(?: [a-z0-9_]++)*+"), F.lit(0))
            words = F.transform(runs, lambda r: F.split(r, " "))
            grams = F.transform(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))
            found = F.array_distinct(F.flatten(grams))
        parts.append(docs.select(key, F.explode(found).alias("term")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(terms, "term")


def extract(docs: DataFrame, terms: list[str] | DataFrame, key: str = "doc_id", text: str = "text", mode: str = "all") -> DataFrame:
    """Distinct ``(key, term)``, terms normalized. ``terms``: a list, or a frame of any size with them in its first column."""
    if isinstance(terms, DataFrame):
        return phrases.extract(docs, terms, key, text, terms.columns[0], mode)
    spark = docs.sparkSession
    joined, matched = split_vocabulary(terms, mode)
    empty = docs.select(key, F.lit("").alias("term")).limit(0)
    out = empty
    if joined:
        lengths = sorted({len(t.split(" ")) for t in joined})
        out = out.unionByName(_word_matches(docs, key, text, spark.createDataFrame([(t,) for t in joined], "term string"), lengths))
    if matched and mode == "all":
        flags = F.array(*[F.when(F.coalesce(F.col(text), F.lit("")).rlike(tx.term_pattern(t)), F.lit(t)) for t in matched])
        out = out.unionByName(docs.select(key, F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("term")))
    elif matched:
        hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(tx.any_term_pattern(matched)), F.lit(1))
        out = out.unionByName(docs.select(key, F.explode(F.array_distinct(F.transform(hits, tx.normalize))).alias("term")))
    return out.distinct()


def extract_words(docs: DataFrame, skills: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``(key, *keep, skill_id)`` for a vocabulary table ``(skill_id, name)`` of single plain words, of any size."""
    rows = docs.select(key, *keep, F.explode(F.array_distinct(tx.words(F.col(text)))).alias("name"))
    found = rows.join(skills.select("skill_id", "name"), "name").select(key, *keep, "skill_id")
    return found.repartition(key, *keep).distinct()  # dealt before they are hashed: a map of a whole input split would fill a task


def profile_skills(docs_or_text, tracked: DataFrame, spark=None) -> DataFrame:
    """The tracked skills ``(skill_id, canonical_name)`` that a person's text names, longest first; ids distinct."""
    rows = tracked.select("skill_id", tx.normalize(F.col("canonical_name")).alias("term"))
    one = (spark or tracked.sparkSession).createDataFrame([(0, docs_or_text or "")], "doc_id int, text string")
    return extract(one, rows.select("term"), mode="longest").join(rows, "term").select("skill_id").distinct()


def vocabulary(skills: DataFrame, technologies: DataFrame) -> DataFrame:
    """``(pos, term, type)``: ``skills`` (pos, term, type) as they are, then of ``technologies`` (pos, term) the first for each
    normal form, as type ``technology``. Numbers follow that order."""
    first = technologies.groupBy(tx.normalize(F.col("term")).alias("norm")).agg(F.min(F.struct("pos", "term")).alias("x")).select("x.*", F.lit("technology").alias("type"))
    both = skills.select(F.lit(0).alias("part"), "pos", "term", "type").unionByName(first.withColumn("part", F.lit(1)))
    return numbering.numbered(both.withColumnRenamed("pos", "__pos"), "pos", ["part", "__pos", "term"]).select("pos", "term", "type")
