"""Paged REST interfaces as a Spark data source: one partition for each path, followed page by page.

``fetch`` is any picklable function from an address to a decoded JSON object, so tests and other transports need
no network. The default uses the standard library, waits between requests and raises on an error status; `with_key`
makes one that sends headers (an API key) and adds parameters.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DELAY_S, TIMEOUT_S = 0.3, 30


def with_parameters(address: str, parameters: dict[str, Any] | None) -> str:
    """``address`` with those ``parameters`` that its query lacks: the address of a next page brings its own."""
    if not parameters:
        return address
    parts = urllib.parse.urlsplit(address)
    own = urllib.parse.parse_qsl(parts.query, keep_blank_values=True)
    more = [(k, v) for k, v in parameters.items() if v is not None and k not in dict(own)]
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(own + more, doseq=True)))


def http_json(address: str, headers: dict[str, str] | None = None, parameters: dict[str, Any] | None = None) -> dict:
    time.sleep(DELAY_S)
    request = urllib.request.Request(with_parameters(address, parameters), headers={"Accept": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as r:
        return json.load(r)


def with_key(headers: dict[str, str] | None = None, parameters: dict[str, Any] | None = None) -> Callable[[str], dict]:
    """`http_json` with headers and parameters, such as ``{"X-API-Key": key}``. They go to the tasks with the function and
    stand in no column and no option."""
    return partial(http_json, headers=headers, parameters=parameters)


def at(page: dict, path: str) -> Any:
    """What stands below ``page`` by names with points between (``_links.hasEssentialSkill``); None where a name is missing. A
    name that holds points itself comes first."""
    if not isinstance(page, dict) or path in page:
        return page.get(path) if isinstance(page, dict) else None
    first, _, rest = path.partition(".")
    return at(page.get(first), rest) if rest else None


def pages(fetch: Callable[[str], dict], address: str, next_key: str = "next") -> Iterator[dict]:
    """The pages from an address on; the next one's address stands under ``next_key`` until it is null."""
    seen = set()
    while address and address not in seen:
        seen.add(address)
        page = fetch(address)
        yield page
        address = at(page, next_key)


class _Path(InputPartition):
    def __init__(self, address: str):
        super().__init__(address)


class _Reader(DataSourceReader):
    def __init__(self, addresses, fetch, items_key, next_key):
        self.addresses, self.fetch, self.items_key, self.next_key = addresses, fetch, items_key, next_key

    def partitions(self):
        return [_Path(a) for a in self.addresses]

    def read(self, partition):
        for page in pages(self.fetch, partition.value, self.next_key):
            for item in at(page, self.items_key) or []:
                yield partition.value, json.dumps(item)


def rest_source(fetch: Callable[[str], dict] = http_json) -> type[DataSource]:
    """A data source class ``paged_rest`` bound to ``fetch``."""

    class PagedRest(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_rest"

        def schema(self) -> str:
            return "address string, item string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(json.loads(self.options["addresses"]), fetch, self.options["items"], self.options.get("next", "next"))

    return PagedRest


def read_pages(spark: SparkSession, addresses: list[str], items: str, ddl: str, fetch: Callable[[str], dict] = http_json, next_key: str = "next") -> DataFrame:
    """The items of all pages of all addresses, typed by ``ddl``, with the address that each came from."""
    spark.dataSource.register(rest_source(fetch))
    rows = spark.read.format("paged_rest").options(addresses=json.dumps(addresses), items=items, next=next_key).load()
    return rows.select("address", F.from_json("item", ddl).alias("row")).select("address", "row.*")


def read_details(keys: DataFrame, key: str, address: str, items: str, ddl: str, fetch: Callable[[str], dict] = http_json, next_key: str = "next") -> DataFrame:
    """``(key, pos, ..., error)``: the items of every row's own pages, ``pos`` counting them.

    ``address`` has ``{key}`` where the row's key goes. A row whose pages can't be fetched is one row with an error, the
    items that came before it stay; null keys have no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch[key]:
                rows = []
                try:
                    for page in pages(fetch, address.replace("{key}", urllib.parse.quote(str(k), safe="")), next_key):
                        rows += [(k, len(rows) + i, json.dumps(x), None) for i, x in enumerate(at(page, items) or [])]
                except Exception as e:  # noqa: BLE001
                    rows.append((k, -1, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=[key, "pos", "item", "error"])

    kind = keys.schema[key].dataType.simpleString()
    rows = keys.select(key).where(F.col(key).isNotNull()).mapInPandas(run, f"{key} {kind}, pos long, item string, error string")
    return rows.select(key, "pos", F.from_json("item", ddl).alias("row"), "error").select(key, "pos", "row.*", "error")


def occupations(hits: DataFrame, prefixes: tuple[str, ...] = ("15-1", "15-2")) -> DataFrame:
    """Search hits (keyword, code, title) as one row for each occupation of the wanted groups, keywords sorted."""
    wanted = F.col("code").startswith(prefixes[0])
    for p in prefixes[1:]:
        wanted = wanted | F.col("code").startswith(p)
    return hits.where(wanted).groupBy("code").agg(F.min("title").alias("title"), F.array_sort(F.collect_set("keyword")).alias("matched_keywords"))


def referred(items: DataFrame, key: str, keep: list[str], by: str = "occupation") -> DataFrame:
    """One row for each key: the first row's fields (by ``pos``) and the list of all that refer to it, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", by))), lambda x: x[by])
    return items.groupBy(key).agg(*[F.min_by(c, "pos").alias(c) for c in keep], ordered.alias("used_by_occupations"))


def technologies(categories: DataFrame) -> DataFrame:
    """Rows (pos, occupation, code, title, example, example_more) as one row for each category; an example's first
    mention stands."""
    both = categories.withColumn("all", F.concat(F.coalesce("example", F.array().cast("array<struct<title:string,hot_technology:boolean,in_demand:boolean>>")), F.coalesce("example_more", F.array().cast("array<struct<title:string,hot_technology:boolean,in_demand:boolean>>"))))
    heads = referred(both, "code", ["title"])
    one = both.select("code", "pos", F.posexplode("all").alias("at", "x")).groupBy("code", F.col("x.title").alias("t")).agg(F.min(F.struct("pos", "at")).alias("first"), F.min_by("x", F.struct("pos", "at")).alias("x"))
    one = one.select("code", "first", F.struct(F.col("x.title").alias("title"), F.coalesce("x.hot_technology", F.lit(False)).alias("hot_technology"), F.coalesce("x.in_demand", F.lit(False)).alias("in_demand")).alias("x"))
    examples = one.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda e: e["x"]).alias("examples"))
    return heads.join(examples, "code", "left").select(F.col("code").alias("category_code"), F.col("title").alias("category_title"), "examples", "used_by_occupations")
