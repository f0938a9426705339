"""Loads that keep what is wrong: every line or file comes out once, among the good rows or with the reason against it.

Reasons are asked for in order, and the first that holds is given. A broken line never fails a load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lexical import decoded_details, normal_key

LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
CHUNK_TYPES = ("idiom", "phrasal", "collocation", "slang")
MOST_BYTES = 10 << 20


def _judged(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """Adds `reason`: the first rule that holds, null if none does."""
    found = F.lit(None).cast("string")
    for reason, bad in reversed(rules):
        found = F.when(F.coalesce(bad, F.lit(True)), reason).otherwise(found)
    return rows.withColumn("reason", found)


def parted(judged: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The good rows with some columns, and the rejected lines (line, reason)."""
    return judged.filter("reason is null").select(*columns), judged.filter("reason is not null").select("line", "reason")


def _once(judged: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of good rows with one key only the first by `order` stays good."""
    place = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(*order))
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (place > 1), "repeated").otherwise(F.col("reason")))


def lexicon_lines(lines: DataFrame) -> DataFrame:
    """line, term, cefr, rank and reason (not_json, no_term, unknown_level, no_rank, repeated) of JSON objects in column `value`."""
    fields = F.from_json("value", "term string, cefr string, rank string, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = lines.select(F.col("value").alias("line"), fields.alias("x")).select("line", "x.*")
    rank = F.col("rank").try_cast("int")
    rows = rows.select("line", "__bad", F.lower(F.trim("term")).alias("term"), "cefr", rank.alias("rank"))
    judged = _judged(rows, ("not_json", F.col("line").isNull() | (F.trim("line") == "") | F.col("__bad").isNotNull()), ("no_term", F.coalesce("term", F.lit("")) == ""), ("unknown_level", ~F.col("cefr").isin(*LEVELS)), ("no_rank", F.col("rank") <= 0))
    return _once(judged, "term", F.col("rank"), F.col("line")).drop("__bad")


def chunk_lines(lines: DataFrame) -> DataFrame:
    """line, key, zh, en, type, labels and reason (not_json, no_key, one_word, repeated) of JSON arrays [key, zh, en, type, labels].

    An unknown type is a collocation, labels that are no list are none.
    """
    cell = F.from_json("value", "array<string>")
    rows = lines.select(F.col("value").alias("line"), cell.alias("c"))
    at = lambda k: F.get("c", F.lit(k))
    labels = F.coalesce(F.from_json(at(4), "array<string>"), F.array().cast("array<string>"))
    type_ = F.when(at(3).isin(*CHUNK_TYPES), at(3)).otherwise("collocation")
    rows = rows.select("line", F.col("c").isNull().alias("bad"), normal_key(F.coalesce(at(0), F.lit(""))).alias("key"), F.nullif(at(1), F.lit("")).alias("zh"), F.nullif(at(2), F.lit("")).alias("en"), type_.alias("type"), F.filter(labels, lambda x: x.isNotNull()).alias("labels"))
    judged = _judged(rows, ("not_json", F.col("bad")), ("no_key", F.col("key") == ""), ("one_word", ~F.col("key").rlike(r"\S[\s-]+\S")))
    return _once(judged, "key", F.desc("line")).drop("bad")


def detail_lines(lines: DataFrame) -> DataFrame:
    """line, word, its details and reason (not_json, too_short, no_word, nothing_in_it) of JSON arrays with eight cells and examples behind."""
    rows = lines.select(F.col("value").alias("line"), F.from_json("value", "array<string>").alias("row"))
    full = rows.withColumn("row", F.when(F.size("row") >= 8, F.col("row")).otherwise(F.concat(F.array(F.lit("?")), F.array_repeat(F.lit(""), 7))))
    named = full.withColumn("row", F.when(F.trim(F.get("row", F.lit(0))) == "", F.concat(F.array(F.lit("?")), F.slice("row", F.lit(2), F.size("row") - 1))).otherwise(F.col("row")))
    told = decoded_details(named.withColumn("row", F.transform("row", lambda x: F.coalesce(x, F.lit("")))), "row", "line").withColumn("c", F.from_json("line", "array<string>"))
    useful = (F.size("senses") > 0) | F.exists("examples", lambda e: F.trim(e["en"]) != "")
    judged = _judged(told, ("not_json", F.col("c").isNull()), ("too_short", F.size("c") < 8), ("no_word", F.coalesce(F.trim(F.get("c", F.lit(0))), F.lit("")) == ""), ("nothing_in_it", ~useful))
    return judged.drop("c")


def probed(files: DataFrame) -> DataFrame:
    """path, ok, title, entries and error (too_large, empty, not_a_feed, broken) of files (path, length, content as text)."""
    root = F.regexp_extract("content", r"(?is)<(rss|feed|rdf:RDF)\b", 1)
    head = F.regexp_extract("content", r"(?is)^(.*?)(?:<(?:item|entry)\b|$)", 1)
    raw = F.regexp_extract(head, r"(?is)<title[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</title>", 1)
    title = raw
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(name), F.lit(sign))
    rows = files.withColumns({"content": F.coalesce("content", F.lit("")), "length": F.coalesce("length", F.lit(0))})
    rows = rows.withColumns({"root": root, "title": F.nullif(title, F.lit("")), "entries": F.regexp_count("content", F.lit(r"(?i)<(item|entry)[\s/>]")).cast("long")})
    whole = F.lower("content").contains(F.concat(F.lit("</"), F.lower("root")))
    judged = _judged(rows, ("too_large", F.col("length") > MOST_BYTES), ("empty", ~F.col("content").rlike(r"\S")), ("not_a_feed", F.col("root") == ""), ("broken", ~whole))
    ok = F.col("reason").isNull()
    return judged.select("path", ok.alias("ok"), F.when(ok, F.col("title")).alias("title"), F.when(ok, F.col("entries")).otherwise(0).alias("entries"), F.col("reason").alias("error"))


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """`probed` for files; those that are too large aren't decoded."""
    files = spark.read.format("binaryFile").load(path)
    return probed(files.select("path", "length", F.when(F.col("length") <= MOST_BYTES, F.col("content").cast("string")).alias("content")))
