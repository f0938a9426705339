"""Building a dictionary from headwords, linked sentences and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import difficulty_tokens

CANDIDATES, EXAMPLES = 6, 2


def examples(sentences: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """word, example, place: of each word's first six sentences (by doc_id) the two shortest; of `words` only, if given."""
    found = sentences.select("doc_id", "sentence", F.explode(F.array_distinct(difficulty_tokens(F.col("sentence")))).alias("word"))
    if words is not None:
        found = found.join(words.select("word").distinct(), "word", "left_semi")
    first = F.row_number().over(Window.partitionBy("word").orderBy("doc_id", "sentence"))
    few = found.withColumn("r", first).filter(F.col("r") <= CANDIDATES)
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.char_length("sentence"), "doc_id", "sentence"))
    return few.withColumn("place", place).filter(F.col("place") <= EXAMPLES).select("word", F.col("sentence").alias("example"), "place")


def linked_sentences(links: DataFrame, english: DataFrame, other: DataFrame) -> DataFrame:
    """Sentence pairs: links (eng_id, other_id) with both texts (id, text)."""
    e, o = english.select(F.col("id").alias("eng_id"), F.col("text").alias("sentence")), other.select(F.col("id").alias("other_id"), F.col("text").alias("translation"))
    return links.join(e, "eng_id").join(o, "other_id").select(F.col("eng_id").alias("doc_id"), "sentence", "translation")


def dictionary(headwords: DataFrame, details: DataFrame, found: DataFrame, most_rank: int | None = None) -> DataFrame:
    """Headwords (word, rank) with details (word, gloss) and examples; those with neither are out."""
    shown = found.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "example"))), lambda x: x["example"]).alias("examples"))
    joined = headwords.join(details, "word", "left").join(shown, "word", "left").filter(F.col("gloss").isNotNull() | F.col("examples").isNotNull())
    return joined if most_rank is None else joined.filter(F.col("rank") <= most_rank)
