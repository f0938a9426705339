"""Interest ranking: affinity joins, an IDF-weighted profile, diversified picks, difficulty order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text

WINDOW = 500


def with_affinity(window: DataFrame, articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """The rows with opens and priorities of their source and category; the joined sides have one row a source or category."""
    source_opens = articles.groupBy("source").agg(F.sum("open_count").alias("source_opens"))
    category_opens = articles.groupBy("category").agg(F.sum("open_count").alias("category_opens"))
    priority = feeds.select(F.col("name").alias("source"), F.col("priority").alias("source_priority"))
    most = feeds.groupBy("category").agg(F.max("priority").alias("category_priority"))
    joined = window.join(source_opens, "source", "left").join(category_opens, "category", "left").join(priority, "source", "left").join(most, "category", "left")
    return joined.fillna(0, ["source_opens", "category_opens", "source_priority", "category_priority"])


def rank(window: DataFrame, articles: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """Adds rank_score, without the profile's part."""
    return with_affinity(window, articles, feeds).withColumn("rank_score", scoring.rank_score(now))


def term_weights(articles: DataFrame) -> DataFrame:
    """The profile: for each title term of engaged articles the sum of their weights (liked 2, completed 1)."""
    engaged = articles.withColumn("weight", F.when(F.col("liked"), 2.0).when(F.col("read_completed"), 1.0)).filter("weight is not null")
    return engaged.select(F.explode(text.content_terms(F.col("title"))).alias("term"), "weight").groupBy("term").agg(F.sum("weight").alias("weight"))


def with_terms(window: DataFrame) -> DataFrame:
    both = F.array_union(text.content_terms(F.col("title")), text.content_terms(text.excerpt(F.col("content_text"))))
    return window.withColumn("terms", both)


def semantic_bonus(window: DataFrame, profile: DataFrame) -> DataFrame:
    """id and bonus: the share of the profile's IDF mass that an article's terms hit, times 0.8. The window is small, so its parts are."""
    exploded = with_terms(window).select("id", F.explode("terms").alias("term"))
    size = window.agg(F.count(F.lit(1)).alias("docs"))
    frequency = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = profile.join(frequency, "term", "left").crossJoin(F.broadcast(size))  # one row
    idf = F.greatest(F.log((1.0 + F.col("docs")) / (1.0 + F.coalesce("df", F.lit(0)))), F.lit(0.0))
    weighted = weighted.select("term", (F.col("weight") * idf).alias("mass"))
    whole = weighted.agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("whole"))
    hits = exploded.join(weighted, "term").groupBy("id").agg(F.sum("mass").alias("hit"))
    return hits.crossJoin(F.broadcast(whole)).select("id", F.when(F.col("whole") > 0, 0.8 * F.least(F.col("hit") / F.col("whole"), F.lit(1.0))).otherwise(0.0).alias("bonus"))


def ranked(window: DataFrame, articles: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """rank_score with the profile's bonus, rounded to 6 places so that it is the same wherever it is computed."""
    scored = rank(window, articles, feeds, now).join(semantic_bonus(window, term_weights(articles)), "id", "left")
    return scored.withColumn("rank_score", F.round(F.col("rank_score") + F.coalesce("bonus", F.lit(0.0)), 6)).drop("bonus")


def diversified(ranked_rows: DataFrame, k: int = 10, per_category: int = 3, per_book: int = 3) -> DataFrame:
    """k unread rows: at most three a category first, then the rest by rank; never more than three of one book."""
    order = [F.desc("rank_score"), F.col("id")]
    unread = ranked_rows.filter("last_opened_at is null")
    own = F.row_number().over(Window.partitionBy("source", F.col("category") == "book").orderBy(*order))
    allowed = unread.withColumn("own", own).filter((F.col("category") != "book") | (F.col("own") <= per_book))
    place = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return allowed.withColumn("round", (place > per_category).cast("int")).orderBy("round", *order).limit(k).drop("own")


def by_difficulty(ranked_rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Re-ordered by rank and difficulty fit; equal scores keep their order."""
    joined = ranked_rows.join(levels, "id", "left")
    return joined.withColumn("adjusted", F.round(F.col("rank_score") + scoring.difficulty_adjustment(F.col("level")), 6)).orderBy(F.desc("adjusted"), F.desc("rank_score"), "id")
