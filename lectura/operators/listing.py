"""Lists, lookups, search and pages over the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_folded

MOST, USUAL = 500, 60


def clamp(limit: int, least: int = 1, most: int = MOST) -> int:
    return max(least, min(limit, most))


def read_state(state: str) -> Column:
    """unread, reading, unfinished or read; any other word means all."""
    opened = F.col("last_opened_at").isNotNull()
    return {"unread": ~F.col("read_completed") & ~opened, "reading": opened & ~F.col("read_completed"), "unfinished": ~F.col("read_completed"), "read": F.col("read_completed")}.get(state, F.lit(True))


def select_articles(df: DataFrame, category: str = "all", source: str | None = None, state: str = "all", liked_only: bool = False, search: str | None = None) -> DataFrame:
    """All conditions at once; every one reaches the scan or the join below it."""
    if category != "all":
        df = df.filter(F.col("category") == category)
    if source is not None:
        df = df.filter(F.col("source") == source)
    if liked_only:
        df = df.filter("liked")
    if search and search.strip():
        needle = search.strip()
        df = df.filter(contains_folded(F.col("title"), needle) | contains_folded(F.col("summary"), needle) | contains_folded(F.col("source"), needle))
    return df.filter(read_state(state))


def newest_first() -> list[Column]:
    return [F.desc("fetched_at"), F.desc("published_at"), F.coalesce("chapter_no", F.lit(0)), F.col("id")]


def page(df: DataFrame, limit: int = USUAL, offset: int = 0) -> DataFrame:
    """The newest articles of a page: a top-k, no full sort."""
    return df.orderBy(*newest_first()).offset(max(0, offset)).limit(clamp(limit))


def search_catalog(books: DataFrame, query: str, limit: int = 40, shelf: str = "") -> DataFrame:
    """By relevance: title begins with the query, holds it, or only the author does; then shorter titles. No query, no rows."""
    needle = query.strip().lower()
    if not needle:
        return books.limit(0)
    title, author = F.lower("title"), F.lower("authors")
    found = books.filter(title.contains(needle) | author.contains(needle))
    if shelf:
        found = found.filter(F.col("shelf") == shelf)
    order = F.when(title.startswith(needle), 0).when(title.contains(needle), 1).otherwise(2)
    return found.withColumn("relevance", order).orderBy("relevance", F.char_length("title"), "title", "gid").limit(clamp(limit, 1, 200))


def keyset_page(ranked: DataFrame, cursor: tuple[float, str] | None = None, offset: int = 0, limit: int = 30) -> DataFrame:
    """The rows behind a cursor (score and id of the last one shown), whatever came in above it; without one, by offset."""
    order = [F.desc("rank_score"), F.col("id")]
    if cursor is None:
        return ranked.orderBy(*order).offset(offset).limit(limit)
    score, id_ = F.lit(float(cursor[0])), cursor[1]
    same = F.abs(F.col("rank_score") - score) <= 1e-9 * F.greatest(F.abs("rank_score"), F.abs(score), F.lit(1.0))
    return ranked.filter((~same & (F.col("rank_score") < score)) | (same & (F.col("id") > id_))).orderBy(*order).limit(limit)


def order_by_ids(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """`wanted` (key, place) first, in its order; all others behind, by their prior place `pos`."""
    return df.join(F.broadcast(wanted), key, "left").orderBy(F.asc_nulls_last("place"), "pos")


def first_per_group(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= most)


def sidebar(feeds: DataFrame, counts: DataFrame) -> DataFrame:
    """Feeds with article counts in sidebar order; curated feeds without articles are hidden, the user's own stay."""
    n = F.coalesce("n_items", F.lit(0))
    joined = feeds.join(counts.withColumnRenamed("source", "name").withColumnRenamed("n", "n_items"), "name", "left").withColumn("n_items", n)
    known = F.array_position(F.array(*map(F.lit, ("world", "tech", "finance", "other", "book"))), F.col("category"))
    return joined.filter((F.col("n_items") > 0) | (F.col("origin") == "user")).withColumn("section", F.when(known == 0, 99).otherwise(known)).orderBy("section", F.desc("enabled"), F.desc("n_items"), "name")
