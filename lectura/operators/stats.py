"""Reading statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAYS = 14


def local_day(at: Column, zone: str = "UTC") -> Column:
    """The day of an instant in a zone; of a text that is no time, its first ten characters."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def counts_by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def opens_by(articles: DataFrame, key: str) -> DataFrame:
    return articles.groupBy(key).agg(F.sum("open_count").alias("opens")).filter("opens > 0")


def top(articles: DataFrame, key: str) -> DataFrame:
    return opens_by(articles, key).orderBy(F.desc("opens"), key).limit(1)


def learning_stats(articles: DataFrame, memory: DataFrame, now: Column) -> DataFrame:
    """One row: articles opened ever, today and this week, words of this week and being learned, favourite source and category."""
    week = now - F.make_dt_interval(days=F.lit(7))
    at = F.col("last_opened_at")
    counts = articles.agg(F.count(at).alias("opened_total"), F.count_if(local_day(at) == local_day(now)).alias("opened_today"), F.count_if(at >= week).alias("opened_7d"))
    word = F.col("kind") == "word"
    learned = memory.agg(F.count_if(word & (F.col("created_at") >= week)).alias("vocab_created_7d"), F.count_if(word & (F.col("status") == "learning")).alias("vocab_learning"))
    best = [top(articles, k).agg(F.first(k).alias(f"top_{k}")) for k in ("source", "category")]  # an aggregate without groups has a row even if there is nothing
    return counts.crossJoin(learned).crossJoin(best[0]).crossJoin(best[1])  # four frames of one row each


def daily(articles: DataFrame) -> DataFrame:
    """Articles, dwell and words by day of the last opening."""
    return articles.filter("last_opened_at is not null").groupBy(local_day(F.col("last_opened_at")).alias("day")).agg(F.count(F.lit(1)).alias("articles"), F.sum("dwell_ms").alias("dwell_ms"), F.sum("word_count").alias("words"))


def daily_series(spark: SparkSession, by_day: DataFrame, today: Column, days: int = DAYS) -> DataFrame:
    """The last days, today included, with zeros where nothing was read."""
    all_days = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return all_days.join(by_day, "day", "left").select("day", zero("articles").alias("articles"), F.expr("coalesce(dwell_ms, 0) div 60000").alias("minutes"), zero("words").alias("words"))


def streak(by_day: DataFrame, today: Column) -> DataFrame:
    """One row: how many days on end were read, ending today or yesterday; else 0."""
    island = F.date_sub(F.col("day"), F.row_number().over(Window.orderBy("day")))  # one row a day: few
    islands = by_day.filter("articles > 0").withColumn("island", island).groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))
    return islands.agg(F.coalesce(F.max(F.when(F.datediff(today, "last").isin(0, 1), F.col("n"))), F.lit(0)).alias("streak"))


def totals(articles: DataFrame, now: Column) -> DataFrame:
    """One row of totals in one pass."""
    opened = F.col("last_opened_at").isNotNull()
    week = F.col("last_opened_at") >= now - F.make_dt_interval(days=F.lit(7))
    zero = lambda c: F.coalesce(c, F.lit(0))
    dwell, dwell_7d = zero(F.sum(F.when(opened, F.col("dwell_ms")))), zero(F.sum(F.when(week, F.col("dwell_ms"))))
    one = articles.agg(
        F.count_if(opened).alias("opened"), F.count_if(week).alias("opened_7d"), F.count_if("read_completed").alias("completed"), F.count_if("liked").alias("liked"), dwell.alias("d"), dwell_7d.alias("d7"), zero(F.sum(F.when(opened, F.col("word_count")))).alias("words")
    )
    return one.select("opened", "opened_7d", "completed", "liked", F.expr("d div 60000").alias("minutes"), F.expr("d7 div 60000").alias("minutes_7d"), "words")


def kind_by_status(memory: DataFrame) -> DataFrame:
    return memory.groupBy("kind").pivot("status", ["learning", "mastered"]).count().fillna(0)


def top_sources(articles: DataFrame, most: int = 6) -> DataFrame:
    by = articles.filter("last_opened_at is not null").groupBy("source").agg(F.count(F.lit(1)).alias("articles"), F.sum("dwell_ms").alias("dwell_ms"))
    return by.orderBy(F.desc("dwell_ms"), F.desc("articles"), "source").limit(most).select("source", "articles", F.expr("dwell_ms div 60000").alias("minutes"))


def reorder(feeds: DataFrame) -> DataFrame:
    """From a wanted order (`pos`) of feeds, each one's priority: its category's size at the top, 1 at the end."""
    by = Window.partitionBy("category")
    return feeds.withColumn("priority", F.count(F.lit(1)).over(by) - F.row_number().over(by.orderBy("pos")) + 1)


def moved(feeds: DataFrame, sections: list[str], category: str, start: int, end: int) -> DataFrame:
    """Feeds (with `pos` in their category) in one flat order `place` from 1, after the feed at `start` of a category (from 0) was drawn to `end`."""
    by = Window.partitionBy("category")
    own = F.row_number().over(by.orderBy("pos")) - 1
    step = (F.when(own == start, end).when((own > start) & (own <= end), own - 1).when((own < start) & (own >= end), own + 1)).cast("int")
    at = F.when((F.col("category") == category) & (start < F.count(F.lit(1)).over(by)), F.coalesce(step, own)).otherwise(own)
    section = F.array_position(F.array(*map(F.lit, sections)), F.col("category"))
    last = F.when(section == 0, len(sections) + 1).otherwise(section)
    # feeds are few; the window holds their ids and places only
    return feeds.withColumn("at", at).withColumn("place", F.row_number().over(Window.orderBy(last, "category", "at"))).drop("at")


def neighbours(chapters: DataFrame) -> DataFrame:
    """For each chapter the ones before and behind it in its book, and the book's size."""
    order = Window.partitionBy("source").orderBy("chapter_no")
    return chapters.select("id", "source", "chapter_no", F.lag("id").over(order).alias("previous"), F.lead("id").over(order).alias("next"), F.count(F.lit(1)).over(Window.partitionBy("source")).alias("chapters"))
