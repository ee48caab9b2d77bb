"""Text as column expressions: everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends a word for matching: ASCII only, so a letter with an accent is a boundary.
NOT_BEFORE, NOT_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WORD_GAP = r"[^A-Za-z0-9_]+"
# Answers of a language model that mean "nothing", as lower-case lines.
NOTHING = ("none", "n/a", "none.", "none apply.")
# Credit phrases at the end of a course title, taken off in this order.
TITLE_TAILS = (
    r"(?i)credit:\s*.+$",
    r"(?i)\(\d+(?:-\d+)?\s*(?:to\s*\d+\s*)?Credits?\)\s*$",
    r"(?i)\(\d+(?:-\d+)?\s*Hours?\)\s*$",
    r"(?i)\.\s*\d+(?:-\d+)?\s*Credit Hours?\.?\s*$",
)
_SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Lower case, stripped, runs of white space as one space; null as the empty string."""
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _SPACES, " "))


def normalize_py(term: str | None) -> str:
    """`normalize` for terms that are on the driver already (vocabularies, function arguments)."""
    return " ".join((term or "").lower().split())


def quote(term: str) -> str:
    """A term as a pattern that Java and Python both read literally."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", term)


def term_pattern(term: str) -> str:
    """Matches the term as a whole, in any case."""
    return f"(?i){NOT_BEFORE}{quote(term)}{NOT_AFTER}"


def any_term_pattern(terms: list[str]) -> str:
    """One pattern for all terms, longest first, so that of overlapping terms the longest at a place matches."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return f"(?i){NOT_BEFORE}({'|'.join(map(quote, ordered))}){NOT_AFTER}"


def words(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores (empty strings at the ends included)."""
    # Lower-case text has no A-Z, so \\W is [^a-z0-9_]; Java tests a negated list of ranges far slower.
    return F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+")


def doc_text(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(body, F.lit("")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def clean_title(c: Column) -> Column:
    out = strip(c)
    for tail in TITLE_TAILS:
        out = strip(F.regexp_replace(out, tail, ""))
    return strip(F.regexp_replace(out, r"\.+$", ""))


def answer_terms(answer: Column) -> Column:
    """The lines of a model's answer as an array of terms: bullets and numbers off, "none" lines out."""
    lines = F.split(F.coalesce(answer, F.lit("")), r"\R")
    cleaned = F.transform(lines, lambda x: strip(F.regexp_replace(strip(F.regexp_replace(strip(x), r"^[-*•]+", "")), r"^\d+[.)]\s*", "")))
    return F.filter(cleaned, lambda x: (x != "") & ~F.lower(x).isin(*NOTHING))


def prompt(text: Column, instruction: str, closing: str) -> Column:
    """A model's prompt: instruction, text, closing, with blank lines between."""
    return F.concat(F.lit(f"{instruction}\n\nTEXT:\n"), F.coalesce(text, F.lit("")), F.lit(f"\n\n{closing}"))


def percent0(rate: Column) -> Column:
    """A rate in whole per cent, halves to even."""
    return F.bround(rate * 100, 0).cast("long").cast("string")


def rationale(skill: Column, coverage: Column, demand: Column, gap: Column, trend: Column) -> Column:
    """Why a recommendation stands where it does. The sentences are fixed values."""
    base = F.concat(skill, F.lit(" appears in "), percent0(demand), F.lit("% of real job postings we sampled, but only "), percent0(coverage), F.lit("% of this program's courses cover it -- a "), percent0(gap), F.lit(" percentage-point gap that's statistically real, not noise."))
    up = F.concat(F.lit(" Demand for "), skill, F.lit(" is also trending upward, making this a higher-priority addition."))
    down = F.concat(F.lit(" That said, demand for "), skill, F.lit(" has been trending downward recently, so this may be a lower priority than it first appears."))
    return F.concat(base, F.when(trend == "rising", up).when(trend == "falling", down).otherwise(F.lit(" No significant demand trend was detected either way over the available time window.")))


def summary(skill: Column, coverage: Column, demand: Column, trend: Column, variant: Column) -> Column:
    """One of three wordings by ``variant``, with a closing on the trend. The sentences are fixed values."""
    tail = F.when(trend == "rising", " Demand is climbing, so this gap is only getting more urgent.").when(trend == "falling", " Demand has cooled recently, though the gap is still real today.").otherwise("")
    cov, dem = percent0(coverage), percent0(demand)
    forms = F.array(
        F.concat(skill, F.lit(" shows up in "), dem, F.lit("% of job postings we sampled, but almost none of this program's courses ("), cov, F.lit("%) cover it.")),
        F.concat(F.lit("Employers ask for "), skill, F.lit(" constantly -- "), dem, F.lit("% of postings -- yet the curriculum barely touches it ("), cov, F.lit("% coverage).")),
        F.concat(F.lit("A clear blind spot: "), skill, F.lit(" is expected in "), dem, F.lit("% of real postings, but this program teaches it in only "), cov, F.lit("% of its courses.")),
    )
    return F.concat(F.element_at(forms, F.pmod(variant, F.lit(3)).cast("int") + 1), tail)


def trend_display(label: Column) -> Column:
    return F.initcap(F.when(label == "no clear trend", "flat").otherwise(label))


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


#: Marks ids and sources of the historical postings. A fixed value.
SAMPLE_PREFIX = "kaggle_"


def with_prefix(c: Column, prefix: str = SAMPLE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def without_prefix(c: Column, prefix: str = SAMPLE_PREFIX) -> Column:
    """Without the prefix where it is there, once."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def latin1(c: Column) -> Column:
    """Characters that Latin-1 lacks as question marks."""
    return F.regexp_replace(c, r"[^\x{00}-\x{FF}]", "?")


def contains_ci(c: Column, text: str) -> Column:
    """SQL ``LIKE '%text%'`` without case; per cent and underscore in ``text`` stay wildcards, a backslash is itself."""
    return c.ilike(re.sub("%+", "%", f"%{text}%").replace("\\", "\\\\"))  # several in a row mean the same and cost much
