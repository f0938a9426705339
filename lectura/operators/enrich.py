"""Batched enrichment by an outside model: halving on failure, one slot for each input, patience with passing failures."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import merge

Model = Callable[[Sequence[str]], Sequence[str]]
BATCH = 16
#: Tries of one call, milliseconds before the second of them, doublings at most.
ATTEMPTS, FIRST_PAUSE_MS, DOUBLINGS = 3, 600, 4


class Refused(Exception):
    """What a model raises when its service answers with an HTTP status that is no success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def passing(failure: Exception) -> bool:
    """Whether a failure may be gone the next time: time-outs, lost connections, answers that are no JSON, 429 and 5xx."""
    if isinstance(failure, Refused):
        return failure.status == 429 or failure.status >= 500
    return isinstance(failure, (TimeoutError, ConnectionError, json.JSONDecodeError))


def patient(model: Model, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Model:
    """The model, asked again after passing failures with pauses that double; other failures come through at once."""

    def ask(items: Sequence[str]) -> Sequence[str]:
        for attempt in range(attempts - 1):
            try:
                return model(items)
            except Exception as failure:
                if not passing(failure):
                    raise
            sleep((FIRST_PAUSE_MS << min(attempt, DOUBLINGS)) / 1000)
        return model(items)

    return ask


def run_with_split(items: Sequence[str], model: Model) -> list[str | None]:
    """The model's answers in order. A batch that fails, or comes back with another length, is tried in halves; a single failure is None."""
    if not items:
        return []
    try:
        answers = list(model(items))
    except Exception:  # noqa: BLE001  whatever an outside model raises costs only its own items
        answers = None
    if answers is not None and len(answers) == len(items):
        return answers
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return run_with_split(items[:half], model) + run_with_split(items[half:], model)


def enriched(df: DataFrame, column: str, model: Model, out: str = "answer", batch: int = BATCH) -> DataFrame:
    """Adds the model's answer for each row; each distinct input of an Arrow batch is asked once."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            asked = list(dict.fromkeys(part.dropna()))
            known: dict[str, str | None] = {}
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                known.update(zip(some, run_with_split(some, model), strict=True))
            yield part.map(known.get)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(column)))


def asked_once(df: DataFrame, column: str, model: Model, out: str = "answer", batch: int = BATCH) -> DataFrame:
    """As `enriched`, but each distinct input of the whole frame is asked once, wherever its rows are. Nulls get null."""
    each = df.select(F.col(column).alias("__asked")).filter("__asked is not null").distinct()
    answers = enriched(each, "__asked", model, "__answer", batch)
    return df.join(answers, F.col(column) == F.col("__asked"), "left").withColumn(out, F.col("__answer")).drop("__asked", "__answer")


def translated(wanted: DataFrame, cached: DataFrame, model: Model, batch: int = BATCH) -> DataFrame:
    """article_id, scope, scope_key, source_text, translated_text and `fresh` of each distinct wanted text.

    A cached translation of the very same text is taken as it is; all others are asked for, each text once, and are
    fresh: those are the rows to save. What the model fails on is null.
    """
    keys = ["article_id", "scope", "scope_key", "source_text"]
    known = cached.select(*keys, F.col("translated_text").alias("__known")).dropDuplicates(keys)
    joined = wanted.select(*keys).distinct().join(known, keys, "left")
    asked = asked_once(joined.filter("__known is null").drop("__known"), "source_text", model, "translated_text", batch)
    return joined.filter("__known is not null").withColumnRenamed("__known", "translated_text").withColumn("fresh", F.lit(False)).unionByName(asked.withColumn("fresh", F.lit(True)))


def needs_fields(kind: Column, definition: Column, word_type: Column) -> Column:
    """Whether a saved word lacks what a model gives; of a phrase the type `phrase` says nothing yet."""
    return (definition == "") | (word_type == "") | ((kind == "phrase") & (word_type == "phrase"))


def enriched_memory(memory: DataFrame, model: Model, batch: int = BATCH) -> DataFrame:
    """Saved words (with `collocations`) with missing fields filled from the model, which is asked for rows that lack some.

    It gets JSON of kind, term and context, and answers JSON of definition, word_type and collocations (phrases keep
    none of the latter; without a type they are `phrase`). An answer that isn't JSON changes nothing.
    """
    lacking = memory.filter(needs_fields(F.col("kind"), F.col("definition"), F.col("word_type")))
    asked = lacking.select("kind", "term", F.to_json(F.struct("kind", "term", F.col("context_sentence").alias("context"))).alias("__ask"))
    told = asked_once(asked, "__ask", model, "__told", batch)
    fields = F.from_json(text.strip_fences(F.col("__told")), "definition string, word_type string, collocations array<string>")
    got = told.withColumn("__got", fields).filter(F.coalesce("__got.definition", "__got.word_type").isNotNull())
    phrase, none = F.col("kind") == "phrase", F.expr("cast(array() as array<string>)")
    type_ = F.coalesce("__got.word_type", F.lit(""))
    new = got.select("kind", "term", F.coalesce("__got.definition", F.lit("")).alias("definition"), F.when(phrase & (type_ == ""), "phrase").otherwise(type_).alias("word_type"), F.when(phrase, none).otherwise(F.coalesce("__got.collocations", none)).alias("collocations"))
    return merge.merge_memory(memory, new)
