"""Free terms to vocabulary terms: exact, by character likeness, or by vectors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions import text
from termlens.operators import fuzzy as nearest_term
from termlens.operators import nearest

FUZZY_CUTOFF, COSINE_CUTOFF = 0.70, 0.65
#: How long a model may take for an answer. A fixed value.
MODEL_SECONDS = 90.0


def lookup(vocabulary: DataFrame, term: str = "term", order: str = "pos") -> DataFrame:
    """``(norm, term)``: of terms with one normal form the last by ``order`` stands."""
    rows = vocabulary.select(text.normalize(F.col(term)).alias("norm"), F.col(term).alias("term"), F.col(order).alias("__pos"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("__pos")))).where("__n = 1 and norm <> ''")
    return rows.select("norm", "term", F.col("__pos").alias("pos"))


def fuzzy(raw: DataFrame, known: DataFrame, column: str = "raw", cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """``raw`` with ``term``: the exact normal form's, else the best by matching blocks at or above the cutoff, else null.

    ``known`` is `lookup`'s result, of any size. Each distinct raw term without an exact match is compared with the vocabulary
    terms that `fuzzy.candidates` leaves.
    """
    rows = raw.withColumn("__norm", text.normalize(F.col(column)))
    exact = rows.select("__norm").distinct().where("__norm <> ''").join(known.select(F.col("norm").alias("__norm"), "term"), "__norm", "left")
    near = nearest_term.nearest(exact.where("term is null").select(F.col("__norm").alias("term")), known.select(F.col("norm").alias("term")), cutoff)
    found = near.join(known.select(F.col("norm").alias("b"), "term"), "b").select(F.col("a").alias("__norm"), "term")
    found = found.unionByName(exact.where("term is not null"))
    return rows.join(found, "__norm", "left").drop("__norm")


def grounded(answers: DataFrame, known: DataFrame, key: str = "item_id", answer: str = "answer") -> DataFrame:
    """``(key, terms, dropped)``: a model's answer as distinct vocabulary terms in order, and how many lines had none."""
    lines = answers.select(key, F.posexplode_outer(text.answer_terms(F.col(answer))).alias("pos", "raw"))
    rows = fuzzy(lines, known)
    first = rows.where("term is not null").groupBy(key, "term").agg(F.min("pos").alias("pos"))
    terms = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    dropped = rows.groupBy(key).agg(F.count_if(F.col("raw").isNotNull() & F.col("term").isNull()).alias("dropped"))
    return dropped.join(terms, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).select(key, "terms", "dropped")


def vector_top1(items: DataFrame, vocabulary: DataFrame, cutoff: float = COSINE_CUTOFF) -> DataFrame:
    """``(item_id, match_id, score)``: each item's nearest vocabulary vector by cosine, if it reaches the cutoff (`nearest.nearest`)."""
    return nearest.nearest(items, vocabulary, cutoff)


def nearest_other(rows: DataFrame, cutoff: float = COSINE_CUTOFF, block: int = nearest.BLOCK, asked: str = "true", places: int = nearest.PLACES) -> DataFrame:
    """``(item_id, match_id, score)``: each row's nearest other row by cosine, if it reaches the cutoff.

    ``asked`` (a condition) chooses the rows that are queries; all rows are searched. Scores that are equal to ``places`` are ties.
    """
    return nearest.nearest(rows.where(asked), rows, cutoff, other=True, block=block, places=places)


def encode(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "text") -> DataFrame:
    """Adds ``vector``: ``encoder`` makes a function from texts to rows of numbers, once for each task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.fillna("").tolist()), dtype=np.float32)))

    return texts.withColumn("vector", run(F.substring(column, 1, 600)))


def local_model(address: str, model: str, timeout: float = MODEL_SECONDS, options: dict | None = None) -> Callable[[], Callable[[str], str]]:
    """A client for `ask`: posts a prompt to a model's server and gives its whole answer, or fails after ``timeout`` seconds."""

    def make():
        def call(prompt: str) -> str:
            body = json.dumps({"model": model, "prompt": prompt, "stream": False, **({"options": options} if options else {})}).encode()
            request = Request(address, data=body, headers={"Content-Type": "application/json"})
            with urlopen(request, timeout=timeout) as r:
                return json.load(r)["response"]

        return call

    return make


def ask(prompts: DataFrame, client: Callable[[], Callable[[str], str]], key: str = "item_id") -> DataFrame:
    """``(key, answer, call_succeeded, error)``: a call for each row; a failed call is a row, not a failed job."""

    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch["prompt"]):
                try:
                    rows.append((k, call(p), True, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "answer", "call_succeeded", "error"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, call_succeeded boolean, error string")


def still_open(items: DataFrame, results: DataFrame, key: str = "item_id") -> DataFrame:
    """Items without a successful call so far: those are asked again."""
    return items.join(results.where("call_succeeded").select(key), key, "left_anti")
