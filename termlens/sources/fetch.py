"""Paged fetching within a time budget, taken up again where it stopped.

The pages themselves are the state: a table with a slice for each run, switched by its manifest (`versions`). A run asks for the
next address of each path that its last page names, as many pages as the time allows, and its pages become part of the table all at once.
So no page that is in the table is asked for again, and a run that dies leaves nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.sources import rest, versions

#: Seconds of a run, and between two requests of a task, as the service asks for. Fixed values.
BUDGET, DELAY = 150.0, 0.3
_PAGE = "path string, n int, address string, body string, next string, error string"
#: Makes, once for each task, a function from an address to (body, next address or none).
Client = Callable[[], Callable[[str], tuple[str, str | None]]]


def whole_pages(headers: dict[str, str] | None = None, timeout: float = 30.0) -> Client:
    """A client for pages of text that name no next one: what the server says the text is encoded in, UTF-8 if it doesn't."""

    def make():
        def get(address: str) -> tuple[str, str | None]:
            request = Request(address, headers=headers or {})
            with urlopen(request, timeout=timeout) as r:
                return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None

        return get

    return make


def linked_pages(get: Callable[[str], dict], next_key: str = "next") -> Client:
    """A client for JSON pages, the next one's address under ``next_key`` (see `rest.at`); ``get`` as `rest.with_key` makes it."""

    def one(address: str) -> tuple[str, str | None]:
        page = get(address)
        return json.dumps(page), rest.at(page, next_key)

    return lambda: one


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, n, address, body, next, error, run)``: all pages so far; ``n`` counts a path's pages, a row with an error has no body."""
    if not versions.manifest(spark, folder)["parts"]:
        return spark.createDataFrame([], f"{_PAGE}, run string")
    return versions.table(spark, folder)


def still_open(paths: DataFrame, got: DataFrame) -> DataFrame:
    """``(path, n, address)``: what each of ``paths`` (path, address) is to ask for next; paths with a last page are left out."""
    last = got.where("error is null").groupBy("path").agg(F.max(F.struct("n", "next")).alias("last"))
    rows = paths.groupBy("path").agg(F.min("address").alias("first")).join(last, "path", "left")
    rows = rows.select("path", F.coalesce(F.col("last.n") + 1, F.lit(0)).alias("n"), F.when(F.col("last").isNull(), F.col("first")).otherwise(F.col("last.next")).alias("address"))
    return rows.where("address is not null")


def run(spark: SparkSession, paths: DataFrame, folder: str, client: Client, seconds: float = BUDGET, delay: float = DELAY, tasks: int = 8) -> DataFrame:
    """Fetches for about ``seconds`` and adds what came to the table at ``folder``; gives ``(path, n, address)`` of what is still open.

    ``tasks`` ask side by side, each with ``delay`` seconds between its requests; a request under way isn't cut. A failed request is a row
    with its error; its path waits for the next run, the others go on. A task that begins after the time asks for nothing. If a
    task is lost and run again, it asks again: only whole runs count. Each path begins at its least address; null paths
    and addresses are left out.
    """
    until = time.time() + seconds

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, asked = client(), False
        for batch in batches:
            for path, n, address in zip(batch["path"], batch["n"], batch["address"]):
                while address is not None and time.time() < until:
                    if asked and delay:
                        time.sleep(delay)
                    asked = True
                    try:
                        body, after = get(address)
                        row = (path, n, address, body, after, None)
                    except Exception as e:  # noqa: BLE001  the service's trouble is a row, not the run's end
                        row, after = (path, n, address, None, None, f"{type(e).__name__}: {e}"), None
                    yield pd.DataFrame([row], columns=["path", "n", "address", "body", "next", "error"])
                    n, address = n + 1, after

    asks = still_open(paths.where("path is not null and address is not null"), pages(spark, folder))
    dealt = asks.repartition(tasks, "path").sortWithinPartitions("path")
    name = uuid.uuid4().hex
    versions.refresh_slices(dealt.mapInPandas(ask, _PAGE).withColumn("run", F.lit(name)), folder, ("run",))
    return still_open(paths.where("path is not null and address is not null"), pages(spark, folder))
