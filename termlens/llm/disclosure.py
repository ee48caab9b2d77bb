"""PII: pattern spans, and information-theoretic sanitisation of what else gives a person away.

The base patterns (e-mail, IP address, card, telephone) are fixed by the query's contract. Every distinct value
found is a protected entity c. The corpus then tells which words give c away: with n_c texts that hold c, n_ct of
them with the word t near c, n_t texts holding t, and N texts (all of them distinct texts: exact copies count
once), t discloses the share ``PMI(c; t) / IC(c) = 1 + log(n_ct / n_t) / log(N / n_c)`` of c's information. Words
over ``GENERALISE`` in a document that holds c are replaced by a general term, those over ``REMOVE`` removed.
A word needs ``SUPPORT`` different contexts: one occurrence says nothing, however often it is copied. Words of one
letter and of more than ``MAX_TERM`` aren't looked at.

DataFrame functions only. Counting is one partial aggregation of words; pairs exist only for words near
entities; no list is collected or broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Possessive quantifiers and the look-behinds keep the same matches and only spare the
# engine starts within a run that has failed already; \G lets a match begin right after the last one.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_SPANS = "array<struct<s:int,e:int,v:string>>"
#: Code points on either side of an entity that are its context.
REACH = 80
SUPPORT, GENERALISE, REMOVE = 2, 0.85, 0.95
MIN_TERM, MAX_TERM = 2, 40
#: Spans that are laid out in one fold.
FOLD = 128
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}


def _laid(parts: Column, length, piece) -> Column:
    """Folds an array in blocks of FOLD: ``piece(x, at)`` of every element with the sum of the lengths before it.

    A fold that appends copies what it has, so one fold over the whole would take time with the square of the size.
    """
    number = lambda z: F.when(F.size(z) > 0, F.sequence(F.lit(0), F.floor((F.size(z) - 1) / FOLD).cast("int"))).otherwise(F.array().cast("array<int>"))
    block = lambda z, b: F.slice(z, b * FOLD + 1, F.lit(FOLD))
    sums = lambda z: F.transform(number(z), lambda b: F.aggregate(block(z, b), F.lit(0), lambda acc, x: acc + length(x)))
    starts = lambda z: F.aggregate(sums(z), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def within(z: Column, at: Column, b: Column) -> Column:
        begin = F.struct(F.get(at, b).alias("at"), F.array().cast(_SPANS).alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(piece(x, acc["at"]))).alias("out"))
        return F.aggregate(block(z, b), begin, step, lambda acc: acc["out"])

    return _let(parts, lambda z: _let(starts(z), lambda at: F.flatten(F.transform(number(z), lambda b: within(z, at, b)))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, not once for each place that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str | Column) -> Column:
    """Matches of ``pattern`` with start and end in code points: what lies between them adds up to their places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Lengths are taken once; the fold adds numbers only.
    zipped = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
    return _laid(zipped, lambda x: x["g"] + x["n"], lambda x, at: F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["n"]).alias("e"), x["m"].alias("v")))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, back.substr(i, F.lit(1)).cast("int")).otherwise(2 * back.substr(i, F.lit(1)).cast("int") - F.when(back.substr(i, F.lit(1)) >= "5", 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(_IP)
    n = F.length(_digits(v))
    if kind == "phone":
        return n.between(9, 15)
    # The check sum is worked out only for as many digits as a card has.
    return F.when(n.between(13, 19), luhn(_digits(v))).otherwise(False)


def found_spans(text: Column, kind: str) -> Column:
    """Valid spans of a kind in a text that isn't null, in order of start."""
    hint = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) & text.rlike("[0-9]") if kind == "phone" else text.rlike(r"[0-9]\.[0-9]") if kind == "ip" else text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    spans = located(text, PATTERNS[kind])
    if kind != "email":
        spans = F.filter(spans, lambda x: _valid(kind, x["v"]))
    return F.when(hint, spans).otherwise(F.array().cast(_SPANS))


def with_spans(rows: DataFrame) -> DataFrame:
    """Adds a column of spans for each kind (named ``__pii_`` and the kind) to rows with ``__pii_text``."""
    return rows.withColumns({f"__pii_{k}": found_spans(F.col("__pii_text"), k) for k in KINDS})


def _any() -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = out | (F.size(f"__pii_{k}") > 0)
    return out


def _entities() -> Column:
    """Hash, start and end of every span of the row."""

    def of(kind: str) -> Column:
        return F.transform(f"__pii_{kind}", lambda x: F.struct(F.xxhash64(F.lit(kind), x["v"]).alias("c"), x["s"].alias("s"), x["e"].alias("e")))

    return F.concat(*map(of, KINDS))


def _terms(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.filter(F.array_distinct(words), lambda w: F.length(w).between(MIN_TERM, MAX_TERM))


def disclosing(rows: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """``(c, term, share)``: the words that give an entity away, from rows with ``__pii_text`` and the spans."""
    text = F.col("__pii_text")
    near = rows.where(_any()).select(text, F.xxhash64(text).alias("h"), F.explode(_entities()).alias("x"))
    first = F.greatest(F.lit(0), F.col("x.s") - REACH)
    before = text.substr(first + 1, F.col("x.s") - first)
    after = text.substr(F.col("x.e") + 1, F.lit(REACH))
    # A word that the cut may have split isn't taken.
    before = F.when(first > 0, F.regexp_replace(before, r"^[\p{L}]+", "")).otherwise(before)
    after = F.when(F.length(after) == REACH, F.regexp_replace(after, r"[\p{L}]+$", "")).otherwise(after)
    near = near.select(F.col("x.c").alias("c"), "h", F.concat_ws(" | ", before, after).alias("context"))
    near = common.cut(near.groupBy("c", "h", F.xxhash64("context").alias("k")).agg(F.any_value("context").alias("context")))
    n_c = near.groupBy("c").agg(F.count_distinct("h").alias("n_c"))
    pairs = near.select("c", "h", "k", F.explode(_terms(F.col("context"))).alias("term")).groupBy("c", "term").agg(F.count_distinct("h").alias("n_ct"), F.count_distinct("k").alias("n_k")).where(F.col("n_k") >= support).drop("n_k")
    texts = rows.groupBy(F.xxhash64(text).alias("h")).agg(F.any_value(text).alias("text"))
    n_t = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = rows.select(F.xxhash64(text).alias("h")).distinct().agg(F.count("*").alias("n"))
    shares = pairs.join(n_t, "term").join(n_c, "c").crossJoin(F.broadcast(total))  # total: one row
    share = 1 + F.log(F.least(F.lit(1.0), F.col("n_ct") / F.col("n_t"))) / F.log(F.greatest(F.lit(2.0), F.col("n") / F.col("n_c")))
    return shares.select("c", "term", share.alias("share")).where(F.col("share") >= least)


def analysed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__pii_text``, the spans of each kind, and ``__pii_term``: spans of disclosing words."""
    rows = with_spans(docs.withColumn("__pii_text", common.text_or_empty()))
    reveal = disclosing(rows)
    own = ["doc_id", F.xxhash64("__pii_text").alias("h")]
    hits = rows.where(_any()).select(*own, F.explode(F.array_distinct(F.transform(_entities(), lambda x: x["c"]))).alias("c")).join(reveal, "c")
    hits = hits.groupBy("doc_id", "h", "term").agg(F.max("share").alias("share")).groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("__pii_reveal"))
    hits = hits.select(F.col("doc_id").alias("__pii_id"), F.col("h").alias("__pii_h"), "__pii_reveal")
    # Only rows with an entity can have disclosing words; the others don't go through the join.
    some = rows.where(_any())
    some = some.join(hits, some["doc_id"].eqNullSafe(hits["__pii_id"]) & (F.xxhash64("__pii_text") == hits["__pii_h"]), "left").drop("__pii_id", "__pii_h")
    # Only the row's own few words are looked for: they are letters, so they can stand in a pattern.
    own_terms = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("__pii_reveal"), "|"), F.lit(r")(?!\p{L})"))
    words = F.filter(located(F.col("__pii_text"), own_terms), lambda x: F.map_contains_key("__pii_reveal", F.lower(x["v"])))
    term = F.transform(words, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(F.element_at("__pii_reveal", F.lower(x["v"])) >= REMOVE, "removed").otherwise("term").alias("v")))
    some = some.withColumn("__pii_term", F.when(F.col("__pii_reveal").isNotNull(), term).otherwise(F.array().cast(_SPANS))).drop("__pii_reveal")
    return rows.where(~_any()).withColumn("__pii_term", F.array().cast(_SPANS)).unionByName(some)


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, email, ip, card, phone, term)`` for each row: arrays of (s, e, v), code points, ends exclusive.

    ``term`` holds the disclosing words, their ``v`` says what `sanitise` does (``term``: a general mark, ``removed``).
    Null and empty texts have empty arrays; null ids and repeated rows keep their row; other columns, whatever
    their names, aren't looked at.
    """
    rows = analysed(docs.select("doc_id", "text"))
    return rows.select("doc_id", *[F.col(f"__pii_{k}").alias(k) for k in (*KINDS, "term")])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with spans replaced by MARKS (overlapping ones by the first's), removed words left out, and
    ``n_chars`` (where there is one) counted anew. A null text stays null; repeated rows and null ids keep their row;
    an empty table gives an empty one; other columns come back as they are, whatever their names; a text is treated whole."""
    rows = analysed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__pii_row")))
    text = F.col("__pii_text")

    def marked(kind: str) -> Column:
        return F.transform(f"__pii_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (F.when(x["v"] == "removed", MARKS["removed"]).otherwise(MARKS[kind]) if kind == "term" else F.lit(MARKS[kind])).alias("m")))

    spans = F.concat(*map(marked, (*KINDS, "term")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        more = F.when(fresh, F.array(text.substr(acc["at"] + 1, x["s"] - acc["at"]), x["m"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    new = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    changed = F.when(F.size(spans) > 0, new).otherwise(F.col("text"))
    own = {c: F.col("__pii_row").getField(c) for c in docs.columns} | {"text": changed}
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("text").isNull(), own["n_chars"]).otherwise(F.length(changed).cast(kind))
    return rows.select(*[x.alias(c) for c, x in own.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_disclosure``: counts and digests of the spans of every whole text of ``documents``."""
    rows = find_pii(common.read(spark, sf_dir, "documents"))
    text = lambda k: F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    base = F.concat(*map(text, KINDS))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, text("term")), ",").alias("spans"), F.size("term").cast("long").alias("n_term"))
