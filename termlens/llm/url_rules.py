"""URL filters: a sort-merge range join of urls with host and path rules.

A host is written backwards, label by label, each label closed by a separator that sorts before every other
character. Then the hosts below a rule's host are one interval of the sort order, and nested rules are nested
intervals. Urls and rules are dealt over the same key ranges (a rule to each range that its interval meets),
each range is sorted, and one sweep keeps the rules whose interval is open on a stack. Only sampled range
bounds reach the driver; their number is the number of partitions. No rule list is broadcast.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common

#: The rules of the registered query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Closes a label in a key, and splits a key from what only orders rows of one host.
LABEL, REST = "\x01", "\x00"
#: Keys sampled to choose range bounds: from this many to twice as many in expectation, whatever the input.
SAMPLE = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.b.c`` as ``c|b|a|`` (``|`` is LABEL): a rule's subdomains are the keys that start with its key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), LABEL), F.lit(LABEL)))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


class _Frame:
    """The rules of one host on the stack: by path, with the path lengths that occur."""

    __slots__ = ("key", "lengths", "paths")

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        known = self.paths.get(path)
        # Two verdicts on one rule: block stands.
        if known is None or verdict == "block":
            self.paths[path] = (rule, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def find(self, path: str) -> tuple[str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (hit := self.paths.get(path[:n])):
                return hit
        return None


def _sweep(default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[_Frame] = []
        part = None
        for batch in batches:
            out = []
            for p, key, is_url, row_id, host, path, rule, verdict in zip(batch["part"], batch["sort_key"], batch["is_url"], batch["row_id"], batch["host"], batch["path"], batch["rule"], batch["verdict"]):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(_Frame(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                best = None
                for frame in stack:
                    hit = frame.find(path)
                    if hit and (best is None or len(hit[0]) >= len(best[0])):
                        best = hit
                out.append((row_id, host, path, best[0] if best else None, best[1] if best else default))
            yield pd.DataFrame(out, columns=["row_id", "host", "path", "rule", "verdict"]).astype({"row_id": "Int64"})

    return run


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row ``(id, host, path, rule, verdict)`` for each row of ``urls``.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; the longest
    rule (host and path together) wins, ``rule`` is its text. No rule: null and ``default``. Null urls and urls
    without ``://`` have empty host and path. Repeated rows and null ids each keep their row; an empty table
    gives an empty result; other columns of ``urls`` and ``rules`` are not looked at. Rules with a null host
    or path are ignored; a rule with an empty host fits every host.
    """
    spark = urls.sparkSession
    n = common.partitions(spark)
    left = urls.select(F.col(id_col).cast("long").alias("row_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    left = left.withColumn("sort_key", F.concat(host_key(F.col("host")), F.lit(REST), "path", F.lit(REST), F.coalesce(F.lpad(F.col("row_id").cast("string"), 20, "0"), F.lit(""))))
    # About SAMPLE keys, the same for the same rows: those whose hash falls in a share that follows the count.
    every = max(1, left.count() // SAMPLE)
    keys = [r[0] for r in left.where(F.pmod(F.xxhash64("sort_key"), F.lit(every)) == 0).select("sort_key").distinct().collect()]
    keys.sort()
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, k)).astype("int32")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, host, path, verdict in zip(batch["sort_key"], batch["host"], batch["path"], batch["verdict"]):
                # The interval of keys that start with `key` ends before `key` followed by the highest character.
                for p in range(bisect_right(bounds, key), bisect_right(bounds, key + "\U0010ffff") + 1):
                    rows.append((p, key, False, None, host, path, host + path, verdict))
            yield pd.DataFrame(rows, columns=["part", "sort_key", "is_url", "row_id", "host", "path", "rule", "verdict"]).astype({"row_id": "Int64"})

    schema = "part int, sort_key string, is_url boolean, row_id long, host string, path string, rule string, verdict string"
    own = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("host is not null and path is not null")
    right = own.withColumn("sort_key", host_key(F.col("host"))).mapInPandas(spread, schema)
    left = left.select(part_of("sort_key").alias("part"), "sort_key", F.lit(True).alias("is_url"), "row_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    dealt = left.unionByName(right).repartition(n, "part").sortWithinPartitions("part", "sort_key", "is_url")
    out = dealt.mapInPandas(_sweep(default), "row_id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("row_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_url_rules``: every url of ``pages`` under RULES."""
    return judge(common.read(spark, sf_dir, "pages"), rules_frame(spark))


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rn
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
