"""Readers: feeds, catalogs, books, word lists. Files are read by Spark, wherever they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog, text

MOST_BYTES, MOST_ENTRIES = 10 << 20, 40

_LINK = "array<struct<_href:string,_rel:string,_type:string,_VALUE:string>>"
_RSS_ITEM = "title string, link string, guid struct<_VALUE:string>, pubDate string, description string, `content:encoded` string"
_ATOM_ENTRY = f"title string, link {_LINK}, id string, published string, updated string, summary string, content string"
CATALOG_COLUMNS = ("gid", "kind", "issued", "title", "language", "authors", "subjects", "locc", "bookshelves")


def _time(value):
    rfc = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3},\s*", ""), r"\s*GMT$", " +0000")
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files: feed (the file), title, url, published, body; at most 40 a file, in their order."""
    found = spark.read.format("xml").option("rowTag", "item").schema(_RSS_ITEM).load(path)
    rows = found.select(
        F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("n"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce(F.nullif(F.trim("link"), F.lit("")), F.trim("guid._VALUE")).alias("url"), _time(F.trim("pubDate")).alias("published"), F.coalesce("`content:encoded`", "description", F.lit("")).alias("body"),
    )
    return _first_entries(rows)


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files as those of `rss`; of several links the alternate one, else the first text/html, else the first, else the id."""
    found = spark.read.format("xml").option("rowTag", "entry").schema(_ATOM_ENTRY).load(path)
    pick = lambda test: F.get(F.filter("link", test), F.lit(0))["_href"]
    url = F.coalesce(pick(lambda x: x["_rel"] == "alternate"), pick(lambda x: x["_type"] == "text/html"), F.get("link", F.lit(0))["_href"], "id")
    rows = found.select(
        F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("n"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"), url.alias("url"),
        F.coalesce(_time(F.trim("published")), _time(F.trim("updated"))).alias("published"), F.coalesce("content", "summary", F.lit("")).alias("body"),
    )
    return _first_entries(rows)


def _first_entries(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("feed").orderBy("n"))
    return rows.withColumn("place", place).filter(F.col("place") <= MOST_ENTRIES).drop("n")


def validated(entries: DataFrame) -> DataFrame:
    """feed, entries, ok for each feed file that has any."""
    return entries.groupBy("feed").agg(F.count(F.lit(1)).alias("entries")).withColumn("ok", F.col("entries") > 0)


def changed_files(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """path, hash, content of files up to 10 MiB whose content differs from what was `seen` (path, hash)."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MOST_BYTES)
    return files.select("path", F.sha2("content", 256).alias("hash"), "content").join(seen, ["path", "hash"], "left_anti")


def pages(html: DataFrame, column: str = "html") -> DataFrame:
    """Adds page_title and page_text: the article's text if there is an article element with 400 words, else the whole page's."""
    inner = F.regexp_extract(column, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    both = html.withColumns({"__own": text.html_to_text(inner), "__whole": text.html_to_text(F.col(column)), "page_title": text.title_from_html(F.col(column))})
    return both.withColumn("page_text", F.when(text.word_count(F.col("__own")) >= 400, F.col("__own")).otherwise(F.col("__whole"))).drop("__own", "__whole")


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Accepted books of a catalog file; rows that aren't whole are dropped."""
    schema = ", ".join(f"{c} string" for c in CATALOG_COLUMNS)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").schema(schema).csv(path)
    rows = raw.filter(catalog.accepted(F.col("gid"), F.col("kind"), F.col("language"), F.col("title")))
    return rows.select(F.trim("gid").cast("long").alias("gid"), text.collapse_spaces(F.col("title")).alias("title"), text.collapse_spaces(F.coalesce("authors", F.lit(""))).alias("authors"), F.trim("issued").alias("issued"), catalog.shelf(F.col("bookshelves")).alias("shelf"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of a JSON array of objects with name, category, url; rows without name or url are dropped."""
    return spark.read.option("multiLine", True).schema("name string, category string, url string").json(path).filter("name is not null and url is not null").withColumn("id", text.slug(F.col("name")))


def books(spark: SparkSession, path: str) -> DataFrame:
    """path, number, title, text of the chapters of plain-text books."""
    from ..functions.reflow import chapters_column

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(chapters_column("value")).alias("number", "chapter")).select("path", F.col("number") + 1, "chapter.title", "chapter.text").toDF("path", "number", "title", "text")


def sentences_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id and text of a file with id, language, text between tabs."""
    return spark.read.option("sep", "\t").option("quote", "").schema("id long, lang string, text string").csv(path)


def links_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("eng_id long, other_id long").csv(path)


def headwords_csv(spark: SparkSession, path: str) -> DataFrame:
    """word, gloss, rank of a dictionary file; rows without word or gloss are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(F.lower(F.trim("word")).alias("word"), F.col("translation").alias("gloss"), F.col("frq").try_cast("int").alias("rank")).filter("word <> '' and gloss is not null")


def lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """term, cefr, rank of word-list lines; rows with an unknown level or without a positive rank are skipped."""
    rows = spark.read.schema("term string, cefr string, rank int").json(path)
    return rows.filter(F.col("cefr").isin("A1", "A2", "B1", "B2", "C1", "C2") & (F.col("rank") > 0) & (F.trim("term") != "")).withColumn("term", F.lower(F.trim("term")))
