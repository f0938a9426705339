"""Row changes as relational transforms: inserts, upserts, upgrades, purges, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates, text


def insert_if_new(stored: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """The new rows whose key isn't stored, the first of each key; run again it adds nothing."""
    return new.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def upsert_latest(stored: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key: the latest, a new one before a stored one of the same time."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("__new")))
    return both.withColumn("__r", rank).filter("__r = 1").drop("__r", "__new")


def upgrades(stored: DataFrame, new: DataFrame, bar: Column) -> DataFrame:
    """For each stored feed article the first new body that is trusted and longer: url, content_text."""
    candidate = new.filter(gates.is_full_text(F.col("content_text"), bar)).select("url", "number", "content_text", F.char_length("content_text").alias("n"))
    old = stored.filter("origin = 'rss'").select("url", F.char_length("content_text").alias("old_n"))
    better = candidate.join(old, "url").filter("n > old_n")
    return better.groupBy("url").agg(F.min_by("content_text", "number").alias("content_text"))


def protected() -> Column:
    """What purges never touch: anything but feed articles, liked ones, and ones being read."""
    return (F.col("origin") != "rss") | F.col("liked") | (F.col("last_opened_at").isNotNull() & ~F.col("read_completed"))


def retained(articles: DataFrame, now: Column, days: int) -> DataFrame:
    """Without old feed articles; 0 days keep all, and rows without any time stay."""
    if days <= 0:
        return articles
    old = F.coalesce("published_at", "fetched_at") < now - F.make_dt_interval(days=F.lit(days))
    return articles.filter(protected() | ~F.coalesce(old, F.lit(False)))


def without_short(articles: DataFrame, least: int = gates.LEAST_WORDS) -> DataFrame:
    return articles.filter(protected() | ~((F.col("word_count") > 0) & (F.col("word_count") < least)))


def without_blocked(articles: DataFrame) -> DataFrame:
    return articles.filter(protected() | ~gates.is_blocked(F.col("title"), F.col("content_text")))


def with_word_counts(articles: DataFrame) -> DataFrame:
    """Missing counts filled in; rows without text dropped."""
    counted = F.when(F.col("word_count") == 0, text.word_count(F.col("content_text"))).otherwise(F.col("word_count"))
    return articles.filter(F.trim("content_text") != "").withColumn("word_count", counted)


def stale_feeds(feeds: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Feeds with `enabled` off where nothing new came for so long; books and feeds without a clock stay."""
    stale = F.col("enabled") & (F.col("kind") != "book") & (F.col("last_new_article_at") < now - F.make_dt_interval(days=F.lit(days)))
    return feeds.withColumn("enabled", F.col("enabled") & ~F.coalesce(stale, F.lit(False)))


def reconcile(stored: DataFrame, seed: DataFrame, key: str = "id") -> DataFrame:
    """Seeded rows: missing ones are added, known ones take the seed's fields but keep their state, obsolete ones go unless they are the user's."""
    fields = [c for c in seed.columns if c != key]
    known = stored.join(seed.select(key, *(F.col(c).alias(f"__{c}") for c in fields)), key).select(key, *(F.col(f"__{c}").alias(c) if c in fields else F.col(c) for c in stored.columns if c != key), F.lit("updated").alias("change"))
    own = stored.join(seed, key, "left_anti").filter("origin = 'user'").withColumn("change", F.lit("kept"))
    new = seed.join(stored, key, "left_anti").withColumn("change", F.lit("added"))
    return known.unionByName(own, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)


def merged_list(old: Column, new: Column) -> Column:
    """The old entries, then new ones (trimmed, not empty) that aren't among them, in order."""
    return F.array_distinct(F.concat(old, F.filter(F.transform(new, lambda t: F.trim(t)), lambda x: x != "")))


def merge_memory(stored: DataFrame, new: DataFrame) -> DataFrame:
    """By kind and folded term: empty fields are filled, a type of `phrase` may be replaced, lists are joined, other rows are added."""
    term = F.lower(F.trim("term"))
    fresh = new.withColumn("__term", term).groupBy("kind", "__term").agg(F.max("definition").alias("__definition"), F.max("word_type").alias("__type"), F.flatten(F.collect_list("collocations")).alias("__list"), F.min("term").alias("__as"))
    old = stored.withColumn("__term", term)
    joined = old.join(fresh, ["kind", "__term"], "full_outer")
    filled = lambda own, other: F.coalesce(F.nullif(own, F.lit("")), other, own)
    kind = F.when(F.coalesce("word_type", F.lit("")).isin("", "phrase"), F.coalesce(F.nullif("__type", F.lit("")), "word_type")).otherwise(F.col("word_type"))
    none = F.expr("cast(array() as array<string>)")
    return joined.select("kind", F.coalesce("term", "__as").alias("term"), filled(F.col("definition"), F.col("__definition")).alias("definition"), kind.alias("word_type"), merged_list(F.coalesce("collocations", none), F.coalesce("__list", none)).alias("collocations"))


def json_list(text_: Column) -> Column:
    """array<string> of a JSON text; empty if it is broken or null."""
    return F.coalesce(F.from_json(text_, "array<string>", {"mode": "PERMISSIVE"}), F.expr("cast(array() as array<string>)"))


def cascaded(children: DataFrame, parents: DataFrame, key: str, parent: str = "id") -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent).alias(key)).distinct(), key, "left_semi")


def nulled(children: DataFrame, parents: DataFrame, key: str, parent: str = "id") -> DataFrame:
    """Children with their reference cleared where the parent is gone."""
    there = parents.select(F.col(parent).alias("__there")).distinct()
    return children.join(there, F.col(key) == F.col("__there"), "left").withColumn(key, F.when(F.col("__there").isNotNull(), F.col(key))).drop("__there")


def valid_translations(paragraphs: DataFrame, translations: DataFrame) -> DataFrame:
    """Paragraphs with their cached translation, if it was made from the very same text."""
    same = translations.select("article_id", "scope_key", "source_text", "translated_text")
    on = (F.col("p.article_id") == F.col("t.article_id")) & (F.col("p.idx").cast("string") == F.col("t.scope_key")) & (F.col("p.text") == F.col("t.source_text"))
    return paragraphs.alias("p").join(same.alias("t"), on, "left").select("p.article_id", "p.idx", F.col("t.translated_text").isNotNull().alias("valid"), "t.translated_text")


def reading_progress(events: DataFrame, most: int = 120_000) -> DataFrame:
    """Dwell and completion of each article from its progress events in order; each step is clamped and the sum never falls below 0."""
    steps = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "delta"))), lambda s: s["delta"])
    clamp = lambda d: F.greatest(F.least(d, F.lit(most)), F.lit(-most))
    folded = F.aggregate(steps, F.lit(0).cast("long"), lambda s, d: F.greatest(F.lit(0).cast("long"), s + clamp(d)))
    return events.groupBy("article_id").agg(folded.alias("dwell_ms"), F.bool_or("done").alias("completed"))
