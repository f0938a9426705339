"""The library as one object: named commands over a folder of Parquet tables.

Reading commands give DataFrames and run nothing. Changes of some rows are appended to a table by key and merged when it
is read; changes of a whole table write it anew. Either way a version counts at once and whole, and a command that
another writer has overtaken runs again on what is there now. Objects aren't shared between threads; tables are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalog, gates, prose, reflow, text
from .operators import dedup, enrich, lexical, listing, merge, ranking, stats
from .sources import readers, writers
from .sources.versions import TRIES, Overtaken, Versions

TABLES = {
    "articles": "id string, number long, url string, title string, source string, category string, content_text string, published_at timestamp_ntz, fetched_at timestamp_ntz, origin string, chapter_no long, summary string, word_count long, open_count long, last_opened_at timestamp_ntz, dwell_ms long, read_completed boolean, liked boolean",
    "feeds": "id string, name string, category string, url string, enabled boolean, origin string, kind string, priority long, fulltext_ratio double, etag string, last_new_article_at timestamp_ntz",
    "categories": "id string, label string, builtin boolean",
    "translations": "article_id string, scope string, scope_key string, source_text string, translated_text string, model string, created_at timestamp_ntz",
    "memory": "id string, kind string, term string, definition string, word_type string, collocations_json string, context_sentence string, article_id string, status string, created_at timestamp_ntz",
    "catalog": "gid long, title string, authors string, issued string, shelf string",
    "meta": "key string, value string",
}
KEYS = {"articles": ["id"], "feeds": ["id"], "categories": ["id"], "translations": ["article_id", "scope", "scope_key"], "memory": ["id"], "catalog": ["gid"], "meta": ["key"]}
BUILTIN_CATEGORIES = ("world", "tech", "finance", "other", "book")
STATUSES = ("learning", "mastered")


def again(command: Callable) -> Callable:
    """A command that runs once more if another writer was faster."""

    @wraps(command)
    def run(self, *args, **kwargs):
        if self._reading is not None:
            return command(self, *args, **kwargs)
        for left in range(TRIES - 1, -1, -1):
            self._reading = {}
            try:
                return command(self, *args, **kwargs)
            except Overtaken:
                if not left:
                    raise
            finally:
                self._reading = None

    return run


class Library:
    """Commands over the tables below `root`, a folder that driver and executors share. `now` is asked for each command."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], Column], model: enrich.Model | None = None):
        self.spark, self.root, self.now, self.model = spark, root.rstrip("/"), now, model
        self._reading: dict[str, int] | None = None  # versions that the running command has read

    # --- tables -----------------------------------------------------------------------------------------------------

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.root}/{name}", TABLES[name], KEYS[name])

    def table(self, name: str) -> DataFrame:
        found = self._versions(name)
        if self._reading is None:
            return found.read()
        return found.read(self._reading.setdefault(name, found.version()))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a table whole; not if another writer has changed it since the running command read it."""
        version = self._versions(name).replace(rows, (self._reading or {}).get(name))
        if self._reading is not None:
            self._reading[name] = version

    def _update(self, name: str, where: Column, **changes: Column) -> None:
        """Appends the rows that change."""
        version = self._versions(name).update(lambda df: df.filter(where).withColumns(changes))
        if self._reading is not None:
            self._reading[name] = version

    # --- articles ---------------------------------------------------------------------------------------------------

    def list_library(self, limit: int = listing.USUAL, offset: int = 0, **conditions) -> DataFrame:
        return listing.page(listing.select_articles(self.table("articles"), **conditions), limit, offset).withColumn("excerpt", text.excerpt(F.col("content_text"))).drop("content_text")

    def list_rank_window(self, cursor: tuple[float, str] | None = None, offset: int = 0, limit: int = 30, **conditions) -> DataFrame:
        articles = self.table("articles")
        window = listing.page(listing.select_articles(articles, **conditions), ranking.WINDOW)
        return listing.keyset_page(ranking.ranked(window, articles, self.table("feeds"), self.now()), cursor, offset, limit)

    def picks(self, k: int = 10) -> DataFrame:
        articles = self.table("articles")
        return ranking.diversified(ranking.ranked(listing.page(articles, ranking.WINDOW), articles, self.table("feeds"), self.now()), k)

    def get_article_view(self, article_id: str) -> DataFrame:
        """idx, paragraph, translation (if it was made from the very same text) of one article."""
        one = self.table("articles").filter(F.col("id") == article_id)
        parts = one.select(F.col("id").alias("article_id"), F.posexplode(reflow.reflow_column("content_text")).alias("idx", "text"))
        cached = self.table("translations").filter((F.col("article_id") == article_id) & (F.col("scope") == "paragraph"))
        valid = merge.valid_translations(parts, cached)
        return parts.join(valid.select("idx", "translated_text"), "idx", "left").orderBy("idx").select("idx", F.col("text").alias("paragraph"), F.col("translated_text").alias("translation"))

    def book_position(self, article_id: str) -> DataFrame:
        return stats.neighbours(self.table("articles").filter("origin = 'book'")).filter(F.col("id") == article_id)

    def mark_article_opened(self, article_id: str) -> None:
        self._update("articles", F.col("id") == article_id, last_opened_at=self.now(), open_count=F.col("open_count") + 1)

    def mark_article_progress(self, article_id: str, delta_ms: int, completed: bool = False) -> None:
        step = max(-120_000, min(120_000, delta_ms))
        self._update("articles", F.col("id") == article_id, dwell_ms=F.greatest(F.lit(0), F.col("dwell_ms") + step), read_completed=F.col("read_completed") | F.lit(completed))

    def set_article_liked(self, article_id: str, liked: bool) -> None:
        self._update("articles", F.col("id") == article_id, liked=F.lit(liked))

    @again
    def delete_article(self, article_id: str) -> None:
        left = self.table("articles").filter(F.col("id") != article_id)
        translations, memory = merge.cascaded(self.table("translations"), left, "article_id"), merge.nulled(self.table("memory"), left, "article_id")
        self.replace("translations", translations)
        self.replace("memory", memory)
        self.replace("articles", left)

    def get_reading_stats(self) -> dict[str, DataFrame]:
        articles, today = self.table("articles"), F.to_date(self.now())
        by_day = stats.daily(articles)
        return {"totals": stats.totals(articles, self.now()), "days": stats.daily_series(self.spark, by_day, today), "streak": stats.streak(by_day, today), "sources": stats.top_sources(articles), "memory": stats.kind_by_status(self.table("memory"))}

    def get_learning_stats(self) -> DataFrame:
        return stats.learning_stats(self.table("articles"), self.table("memory"), self.now())

    # --- translation and cards: an outside model that the caller brings -----------------------------------------------

    def translate_full_article(self, article_id: str, model: enrich.Model) -> DataFrame:
        """Translates the paragraphs without a valid translation, keeps the answers, gives the view."""
        missing = self.get_article_view(article_id).filter("translation is null")
        made = enrich.enriched(missing, "paragraph", model, "translated_text", batch=8).filter("translated_text is not null")
        rows = made.select(F.lit(article_id).alias("article_id"), F.lit("paragraph").alias("scope"), F.col("idx").cast("string").alias("scope_key"), F.col("paragraph").alias("source_text"), "translated_text", F.lit("model").alias("model"), self.now().alias("created_at"))
        self.save_translations(rows)
        return self.get_article_view(article_id)

    def translate_selection(self, article_id: str, selection: str, model: enrich.Model) -> DataFrame:
        key = self.spark.range(1).select(text.fnv1a64_hex(F.lit(selection)).alias("scope_key"))
        known = self.table("translations").filter((F.col("article_id") == article_id) & (F.col("scope") == "selection") & (F.col("source_text") == selection))
        if known.isEmpty():
            made = enrich.enriched(key.withColumn("source_text", F.lit(selection)), "source_text", model, "translated_text").filter("translated_text is not null")
            self.save_translations(made.select(F.lit(article_id).alias("article_id"), F.lit("selection").alias("scope"), "scope_key", "source_text", "translated_text", F.lit("model").alias("model"), self.now().alias("created_at")))
        return self.table("translations").filter((F.col("article_id") == article_id) & (F.col("scope") == "selection") & (F.col("source_text") == selection))

    @again
    def save_translations(self, rows: DataFrame) -> None:
        self.replace("translations", merge.upsert_latest(self.table("translations"), rows, ["article_id", "scope", "scope_key"], "created_at"))

    @again
    def fill_missing_cards(self, model: enrich.Model, most: int = 200) -> None:
        """Summaries for the newest articles without one."""
        articles = self.table("articles")
        queue = articles.filter((F.trim("summary") == "") & (F.col("origin") != "book")).orderBy(F.desc("fetched_at"), "id").limit(most)
        made = enrich.enriched(queue.select("id", "title"), "title", model, "card").select("id", text.clip(F.col("card"), 200).alias("card"))
        self.replace("articles", articles.join(made, "id", "left").withColumn("summary", F.coalesce("card", "summary")))

    # --- feeds ------------------------------------------------------------------------------------------------------

    def list_feeds(self) -> DataFrame:
        return self.table("feeds").orderBy("category", F.desc("priority"), "name")

    def sidebar(self) -> DataFrame:
        return listing.sidebar(self.table("feeds"), stats.counts_by_source(self.table("articles")))

    def set_feed_enabled(self, feed_id: str, enabled: bool) -> None:
        """Switching a feed on restarts its clock."""
        self._update("feeds", F.col("id") == feed_id, enabled=F.lit(enabled), last_new_article_at=self.now() if enabled else F.col("last_new_article_at"))

    @again
    def reorder_feeds(self, ids: list[str]) -> None:
        """Priorities by the wanted order; unknown and blank ids are ignored, feeds that aren't named keep theirs."""
        wanted = self.spark.createDataFrame([(i.strip(), k) for k, i in enumerate(ids) if i.strip()], "id string, pos int")
        feeds = self.table("feeds")
        placed = stats.reorder(feeds.drop("priority").join(wanted, "id")).select("id", F.col("priority").alias("placed"))
        self.replace("feeds", feeds.join(placed, "id", "left").withColumn("priority", F.coalesce("placed", "priority")))

    @again
    def delete_feed_source(self, feed_id: str) -> None:
        """The user's feeds and books only; a book takes its chapters along."""
        feeds = self.table("feeds")
        gone = feeds.filter((F.col("id") == feed_id) & ((F.col("origin") == "user") | (F.col("kind") == "book")))
        self.replace("articles", self.table("articles").join(gone.filter("kind = 'book'").select(F.col("name").alias("source")), "source", "left_anti"))
        self.replace("feeds", feeds.join(gone.select("id"), "id", "left_anti"))

    def list_feed_categories(self) -> DataFrame:
        return self.table("categories").orderBy(F.desc("builtin"), "label")

    def list_source_article_counts(self) -> DataFrame:
        return stats.counts_by_source(self.table("articles"))

    @again
    def add_feed_category(self, label: str) -> None:
        new = self.spark.createDataFrame([(label.strip(),)], "label string").select(text.slug(F.col("label")).alias("id"), "label", F.lit(False).alias("builtin"))
        known = self.table("categories")
        self.replace("categories", known.unionByName(new.join(known, "id", "left_anti").select(*known.columns)))

    @again
    def subscribe_feed(self, name: str, url: str, category: str) -> None:
        """Adds a feed unless its url is known; an id that is taken gets a suffix of the url's hash."""
        feeds = self.table("feeds")
        new = self.spark.createDataFrame([(name, url, category)], "name string, url string, category string").join(feeds.select("url"), "url", "left_anti")
        new = new.select(text.slug(F.col("name")).alias("id"), "name", "url", "category")
        taken = new.join(feeds.select("id"), "id", "left_semi").withColumn("id", F.concat("id", F.lit("-"), F.left(F.md5("url"), F.lit(8))))
        fresh = new.join(feeds.select("id"), "id", "left_anti").unionByName(taken.select("id", "name", "url", "category"))
        state = {"enabled": F.lit(True), "origin": F.lit("user"), "kind": F.lit("rss"), "priority": F.lit(0), "fulltext_ratio": F.lit(-1.0), "last_new_article_at": self.now()}
        self.replace("feeds", feeds.unionByName(fresh.withColumns(state), allowMissingColumns=True))

    @again
    def seed_feeds(self, seed: DataFrame) -> None:
        self.replace("feeds", merge.reconcile(self.table("feeds"), seed).withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "origin": F.coalesce("origin", F.lit("curated")), "kind": F.coalesce("kind", F.lit("rss")), "priority": F.coalesce("priority", F.lit(0)), "fulltext_ratio": F.coalesce("fulltext_ratio", F.lit(-1.0))}))

    def validate_feed(self, path: str) -> DataFrame:
        return readers.validated(readers.rss(self.spark, path))

    @again
    def refresh_feeds(self, entries: DataFrame, days: int = 14) -> None:
        """Adds accepted entries (url, title, source, category, body, published, lang), upgrades bodies, purges, retires stale feeds."""
        articles = merge.retained(merge.without_short(self.table("articles")), self.now(), days)
        bar = F.coalesce("bar", F.lit(gates.TRUST_CHARS))
        feeds = self.table("feeds")
        bars = feeds.select(F.col("name").alias("source"), gates.trust_chars(F.col("fulltext_ratio")).alias("bar"))
        new = entries.select("source", "category", text.canonical_url(F.col("url")).alias("url"), "title", prose.clean_body_column("body").alias("content_text"), F.col("published").alias("published_at"), "lang").join(bars, "source", "left")
        old = F.coalesce(F.col("published_at") < self.now() - F.make_dt_interval(days=F.lit(days)), F.lit(False)) if days else F.lit(False)
        new = new.filter(~old).withColumn("number", F.xxhash64("url"))
        better = merge.upgrades(articles, new, bar)
        body, title = F.col("content_text"), F.col("title")
        good = new.filter(gates.reject_reason(body).isNull() & ~gates.looks_like_paywall(body)).filter(gates.is_english(F.col("lang"), title, body) & ~gates.is_blocked(title, body))
        fresh = merge.insert_if_new(articles, good)
        # titles of the last days come first, so that an entry gives way to what is there
        recent = articles.filter(F.coalesce("published_at", "fetched_at") >= self.now() - F.make_dt_interval(days=F.lit(14)))
        both = recent.select(F.concat(F.lit("0"), "url").alias("o"), "url", "title").unionByName(fresh.select(F.concat(F.lit("1"), "url").alias("o"), "url", "title"))
        kept = dedup.greedy_kept(both, key="url", order="o")
        stamp = F.concat(F.lit("a"), F.left(F.sha2("url", 256), F.lit(16)))
        added = fresh.join(kept, "url", "left_semi").select(
            stamp.alias("id"), "number", "url", "title", "source", "category", "content_text", "published_at", self.now().alias("fetched_at"), F.lit("rss").alias("origin"), F.lit("").alias("summary"), text.word_count(body).alias("word_count"),
            F.lit(0).alias("open_count"), F.lit(0).alias("dwell_ms"), F.lit(False).alias("read_completed"), F.lit(False).alias("liked"),
        )
        upgraded = articles.join(better.select("url", F.col("content_text").alias("better")), "url", "left")
        changed = upgraded.filter("better is not null").select(F.col("id").alias("article_id"))
        self.replace("translations", self.table("translations").join(changed, "article_id", "left_anti"))
        upgraded = upgraded.withColumn("word_count", F.when(F.col("better").isNotNull(), text.word_count(F.col("better"))).otherwise(F.col("word_count"))).withColumn("content_text", F.coalesce("better", "content_text")).drop("better")
        seen = new.groupBy("source").agg(F.avg(gates.is_full_text(body, bar).cast("int")).alias("ratio"))
        clocks = added.groupBy("source").agg(F.max("fetched_at").alias("at"))
        met = feeds.join(seen.withColumnRenamed("source", "name"), "name", "left").join(clocks.withColumnRenamed("source", "name"), "name", "left")
        met = met.withColumns({"fulltext_ratio": F.coalesce("ratio", "fulltext_ratio"), "last_new_article_at": F.coalesce("at", "last_new_article_at")}).select(*feeds.columns)
        self.replace("articles", upgraded.unionByName(added, allowMissingColumns=True))
        self.replace("feeds", merge.stale_feeds(met, self.now()))

    # --- memory -----------------------------------------------------------------------------------------------------

    @again
    def add_memory(self, kind: str, term: str, definition: str = "", word_type: str = "", collocations: list[str] | None = None, context: str = "", article_id: str | None = None) -> None:
        """A new word or phrase, or more about a known one: empty fields are filled, lists are joined."""
        memory = self.table("memory").withColumn("collocations", merge.json_list(F.col("collocations_json")))
        new = self.spark.createDataFrame([(kind, term, definition, word_type, collocations or [])], "kind string, term string, definition string, word_type string, collocations array<string>")
        key = [F.col("kind"), F.lower(F.trim("term"))]
        merged = merge.merge_memory(memory, new).withColumn("__k", F.concat_ws("\0", *key))
        state = memory.select(F.concat_ws("\0", *key).alias("__k"), "id", "context_sentence", "article_id", "status", "created_at")
        fresh = F.concat(F.lit("m"), F.left(F.sha2("__k", 256), F.lit(16)))
        rows = merged.join(state, "__k", "left").withColumns({"id": F.coalesce("id", fresh), "status": F.coalesce("status", F.lit("learning")), "created_at": F.coalesce("created_at", self.now()), "context_sentence": F.coalesce("context_sentence", F.lit(context)), "article_id": F.coalesce("article_id", F.lit(article_id).cast("string")), "collocations_json": F.to_json("collocations")})
        self.replace("memory", rows)

    def list_memory(self, kind: str | None = None, status: str | None = None) -> DataFrame:
        rows = self.table("memory")
        for column, wanted in (("kind", kind), ("status", status)):
            if wanted:
                rows = rows.filter(F.col(column) == wanted)
        return rows.orderBy(F.desc("created_at"), "id")

    def set_memory_status(self, memory_id: str, status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}")
        self._update("memory", F.col("id") == memory_id, status=F.lit(status))

    @again
    def delete_memory(self, memory_id: str) -> None:
        self.replace("memory", self.table("memory").filter(F.col("id") != memory_id))

    def export_memory_csv(self, path: str) -> None:
        writers.write_memory_csv(self.list_memory(), path)

    # --- books, words -----------------------------------------------------------------------------------------------

    @again
    def ensure_book_catalog(self, path: str) -> None:
        self.replace("catalog", readers.catalog_csv(self.spark, path))

    def search_books(self, query: str, shelf: str = "", limit: int = 40) -> DataFrame:
        imported = self.table("feeds").filter("kind = 'book'").select(catalog.gid_of(F.col("url")).alias("there"))
        found = listing.search_catalog(self.table("catalog"), query, limit, shelf)
        return found.join(F.broadcast(imported), F.col("gid") == F.col("there"), "left").withColumn("imported", F.col("there").isNotNull()).drop("there")

    @again
    def import_book(self, path: str, name: str, url: str) -> None:
        """One feed and an article for each chapter; chapters that are there stay as they are."""
        chapters = readers.books(self.spark, path)
        at = F.concat(F.lit(url + "#ch-"), F.col("number").cast("string"))
        rows = chapters.select(
            F.concat(F.lit("b"), F.left(F.sha2(at, 256), F.lit(16))).alias("id"), F.col("number").cast("long").alias("number"), at.alias("url"), "title", F.lit(name).alias("source"), F.lit("book").alias("category"), F.col("text").alias("content_text"), self.now().alias("fetched_at"),
            F.lit("book").alias("origin"), F.col("number").cast("long").alias("chapter_no"), F.lit("").alias("summary"), text.word_count(F.col("text")).alias("word_count"), F.lit(0).alias("open_count"), F.lit(0).alias("dwell_ms"), F.lit(False).alias("read_completed"), F.lit(False).alias("liked"),
        )
        articles = self.table("articles")
        self.subscribe_feed(name, url, "book")
        self._update("feeds", F.col("url") == url, kind=F.lit("book"))
        self.replace("articles", articles.unionByName(merge.insert_if_new(articles, rows), allowMissingColumns=True))

    def difficulty(self, lexicon: DataFrame) -> DataFrame:
        """id, score and level of the articles, by edges calibrated on them."""
        scores = lexical.difficulty(self.table("articles"), lexicon, self.list_memory(status="learning"))
        return lexical.with_levels(scores, lexical.calibrated_edges(scores))

    # --- settings, copies -------------------------------------------------------------------------------------------

    @again
    def save_config(self, **values: str) -> None:
        new = self.spark.createDataFrame(list(values.items()), "key string, value string")
        known = self.table("meta").join(new.select("key"), "key", "left_anti")
        self.replace("meta", known.unionByName(new))

    def get_config(self, **defaults: str) -> dict[str, str]:
        """All settings; a bounded table of a few rows."""
        return defaults | {r["key"]: r["value"] for r in self.table("meta").collect()}

    def once(self, key: str, run: Callable[[], None]) -> bool:
        """Runs something the first time it is asked for under a key."""
        if key in self.get_config():
            return False
        run()
        self.save_config(**{key: "done"})
        return True

    def backup_database(self, path: str) -> None:
        for name in TABLES:
            writers.write_snapshot(self.table(name), f"{path}/{name}")
