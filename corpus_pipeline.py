"""A training corpus from raw documents: language, near copies, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. Null and empty texts go with the first stage (their language is unknown); empty tables stay empty;
further columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectura.llm import bpe, decontaminate, langid, pii, simhash
from lectura.llm.common import kept, read
from lectura.llm.queries import surrogate_key

#: A text with a lower share of n-grams that its predicted language is known to have is in no learned language.
LEAST_KNOWN = 0.75
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language, by a model of the documents' own labels."""
    model = langid.fit(docs)
    judged = langid.identify(docs, model, predicted="__lang", score="__score", known="__known")
    return judged.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__known") >= LEAST_KNOWN)).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies: met by pigeonring SimHash, then five-word shingles 0.8 alike or more."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, re-parameterised ones included."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates for personal data into the texts."""
    return pii.replace_private(docs, surrogate_key(spark), entities=None)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the texts' token ids."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("personal_data", replace_personal_data),
    ("token_ids", encode_texts),
]

#: Kernels, hashes and merges can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, kept(docs) if number else docs, sf_dir)
    return docs
