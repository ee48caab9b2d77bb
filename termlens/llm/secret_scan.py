"""Secret scans: plain patterns, and an assignment-aware reading of source and configuration text.

The base patterns are fixed by the query's contract. The method on top of them lexes ``name = literal`` pairs
(``=``, ``:``, ``:=``, ``=>``; quoted or bare literals; dotted, indexed and quoted names of any length) and quoted strings, whose
inside isn't code; comments are read like code, since a key in a comment is disclosed too. It follows names that are
assigned to other names (``A``, ``$A``, ``${A}``: the latest assignment before the place, else the first after it), and scores each literal by how sensitive the names are that it reaches and by how
much it looks like a key rather than a word or a placeholder.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 and more are the runs of one and more that are long enough.
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weights of the words of a sensitive name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.6, "access": 0.5, "key": 0.5, "signature": 0.5, "bearer": 0.8, "salt": 0.5}
#: A text without any of these has no sensitive name.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "auth", "private", "access", "signature", "bearer", "salt")
#: Bare stems of the base pattern's names.
BASE_HINTS = ("passw", "secret", "token", "api")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|(?:your|my|the)[-_ ].*|change.?me|example.*|placeholder|dummy|test|none|null|true|false|undefined|\$\{.*|<.*>|%.*%)$")
#: A token of source or configuration text: an assignment, or a quoted string that is none (what stands in it isn't code).
#: All repeated parts are possessive, so names and literals of any length take linear time.
TOKEN = re.compile(
    r"""(?<![\w.\-"'])(?:(?P<nq>["'])(?P<quoted>[A-Za-z_][\w.\-]*+)(?P=nq)|(?P<name>[A-Za-z_][\w.\-]*+)(?:\[(?P<iq>["'])(?P<index>[^"'\]\n]++)(?P=iq)\])?+)"""
    r"""[\x20\t]*+(?::=|=>|=(?!=)|:(?!//|:))[\x20\t]*+"""
    r"""(?:(?P<q>["'`])(?P<lit>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)|(?P<bare>\$\{[A-Za-z_][\w.\-]*+\}|[^\s"'`,;(){}\[\]]++))"""
    r"""|(?<![\w"'`])(?P<s>["'`])(?:\\.|(?!(?P=s))[^\\\n])*+(?P=s)"""
)
#: A literal that is a variable of a shell or a template.
VARIABLE = re.compile(r"\$(?:\{([A-Za-z_][\w.\-]*+)\}|([A-Za-z_]\w*+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Least product of name and literal score that makes a span.
LEAST = 0.45


def sensitivity(name: str) -> float:
    """0 to 1: how sure a target of this name holds a secret."""
    words = [w.lower() for w in WORDS.findall(name)]
    scores = [SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE.get(a + b, 0.0) for a, b in zip(words, words[1:])]
    return 1 - math.prod(1 - s for s in scores) if scores else 0.0


def strength(literal: str) -> float:
    """0 to 1: how much a literal looks like a key; by length and entropy of its characters."""
    if len(literal) < 8 or PLACEHOLDER.match(literal) or " " in literal.strip():
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    mixed = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.5) * (0.6 + 0.2 * min(2, mixed - 1))


def literals(text: str, least: float = LEAST) -> list[tuple[int, int, float]]:
    """Spans of literals that reach a sensitive name, with their scores, in order of start."""
    # Assignments in order: name, span of the literal, name that it may refer to.
    pairs: list[tuple[str, tuple[int, int], str | None]] = []
    at: dict[str, list[int]] = {}
    for m in TOKEN.finditer(text):
        if m["s"]:
            continue
        # An element is named by what it belongs to and its own key.
        name = m["quoted"] or (f'{m["name"]}.{m["index"]}' if m["index"] else m["name"])
        value = m["lit"] if m["q"] else m["bare"]
        variable = VARIABLE.fullmatch(value)
        ref = variable[1] or variable[2] if variable else None if m["q"] else value
        at.setdefault(name, []).append(len(pairs))
        pairs.append((name, m.span("lit" if m["q"] else "bare"), ref))

    sources: dict[int, tuple[int, int] | None] = {}

    def source(k: int) -> tuple[int, int]:
        """The literal that reaches assignment ``k``; its own where names only refer to one another."""
        first, path = k, {}
        while k not in sources and k not in path and (ref := pairs[k][2]) in at:
            path[k] = None
            places = at[ref]
            k = places[max(0, bisect_left(places, k) - 1)]
        end = sources[k] if k in sources else None if k in path else pairs[k][1]
        sources.update(dict.fromkeys(path, end))
        return end or pairs[first][1]

    best: dict[tuple[int, int], float] = {}
    for k, (name, _, _) in enumerate(pairs):
        score = sensitivity(name)
        if not score:
            continue
        span = source(k)
        total = score * strength(text[span[0] : span[1]])
        if total >= least:
            best[span] = max(total, best.get(span, 0.0))
    return [(*span, best[span]) for span in sorted(best)]


def scan(text: str) -> tuple[list[tuple[int, int, int]], float]:
    """Spans ``(start, kind number, end)`` in code points, sorted, and the highest score of a literal."""
    lower = text.lower() if text.isascii() else text.translate(_LOWER)
    spans = []
    if any(h in lower for h in BASE_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    top = 0.0
    if any(h in lower for h in HINTS) and ("=" in text or ":" in text):
        for start, end, score in literals(text):
            spans.append((start, 3, end))
            top = max(top, score)
    return sorted(spans), top


_LOWER = {c: c + 32 for c in range(65, 91)}


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kinds, starts, ends, score)`` for each row: arrays of equal length, sorted by start and kind.

    Offsets are code points, ends exclusive. Null and empty texts have empty arrays; null ids and repeated
    rows keep their row; other columns aren't looked at. A text is scanned as a whole, whatever its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "kinds": [[KINDS[k] for _, k, _ in s] for s, _ in found], "starts": [[x[0] for x in s] for s, _ in found], "ends": [[x[2] for x in s] for s, _ in found], "score": [top for _, top in found]})

    rows = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, kinds array<string>, starts array<long>, ends array<long>, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_secret_scan``: counts and digests of the spans of every whole text of ``documents``."""
    found = find_secrets(common.read(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s["kinds"].alias("k"), F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("t")))
    found = found.withColumn("s", spans)
    count = lambda k: F.size(F.filter("s", lambda x: x["k"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["t"]), ",")
    base = F.filter("s", lambda x: x["k"] != "literal")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), count("literal").alias("n_literal"), "score")
