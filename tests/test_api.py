"""The library's commands one after another."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectura.api import Library
from lectura.plans import library as L


@pytest.fixture
def lib(spark, small, tmp_path):
    made = Library(spark, str(tmp_path / "lib"), L.now_column)
    made.replace("articles", L.articles(spark, small).limit(40))
    made.replace("feeds", L.feeds(spark, small))
    return made


def one(df, **where):
    for c, v in where.items():
        df = df.filter(F.col(c) == v)
    return df.first()


def test_articles(lib):
    first = lib.list_library(limit=5).collect()
    assert len(first) == 5 and lib.list_rank_window(limit=7).count() == 7 and lib.picks(5).count() <= 5
    a = first[0]["id"]
    before = one(lib.table("articles"), id=a)
    lib.mark_article_opened(a)
    lib.mark_article_progress(a, 500_000)
    lib.mark_article_progress(a, -10, completed=True)
    lib.set_article_liked(a, True)
    after = one(lib.table("articles"), id=a)
    assert after["open_count"] == before["open_count"] + 1 and after["dwell_ms"] == before["dwell_ms"] + 120_000 - 10 and after["read_completed"] and after["liked"]
    assert lib.get_reading_stats()["days"].count() == 14 and lib.get_learning_stats().first()["opened_today"] == 1
    upper = lambda items: [x.upper() for x in items]
    view = lib.translate_full_article(a, upper).collect()
    assert view and all(r["translation"] == r["paragraph"].upper() for r in view)
    assert lib.translate_selection(a, "two words", upper).first()["translated_text"] == "TWO WORDS"
    lib.fill_missing_cards(upper, 3)
    lib.delete_article(a)
    assert lib.table("articles").count() == 39 and lib.table("translations").count() == 0


def test_feeds_and_refresh(lib, spark):
    lib.subscribe_feed("New Feed", "https://f.example/rss", "world")
    lib.subscribe_feed("New Feed", "https://f.example/rss", "world")
    lib.subscribe_feed("New feed", "https://g.example/rss", "world")
    mine = [r["id"] for r in lib.list_feeds().filter("origin = 'user' and id like 'new%'").collect()]
    assert len(mine) == 2 and "new-feed" in mine
    lib.reorder_feeds([mine[1], "nope", " ", mine[0]])
    assert one(lib.table("feeds"), id=mine[1])["priority"] > one(lib.table("feeds"), id=mine[0])["priority"]
    lib.set_feed_enabled(mine[0], False)
    assert not one(lib.table("feeds"), id=mine[0])["enabled"]
    body = "A sentence of plain English words stands here for the reader. " * 60
    rows = [("https://f.example/1?utm_source=x", "A long enough title about nothing in particular today", "New Feed", "world", body, "2024-01-30 00:00:00", "en"), ("https://f.example/1", "same url", "New Feed", "world", body, "2024-01-30 00:00:00", "en"),
            ("https://f.example/2", "short", "New Feed", "world", "too short", "2024-01-30 00:00:00", "en"), ("https://f.example/3", "old", "New Feed", "world", body, "2023-01-30 00:00:00", "en"), ("https://f.example/4", "fremd", "New Feed", "world", body, "2024-01-30 00:00:00", "de")]
    entries = spark.createDataFrame(rows, "url string, title string, source string, category string, body string, published string, lang string").withColumn("published", F.col("published").cast("timestamp_ntz"))
    lib.refresh_feeds(entries)
    assert lib.table("articles").filter("source = 'New Feed'").count() == 1
    lib.refresh_feeds(entries)
    assert lib.table("articles").filter("source = 'New Feed'").count() == 1
    lib.refresh_feeds(entries.filter("title = 'same url'").withColumn("body", F.concat("body", F.lit("And more of it."))))
    got = one(lib.table("articles"), source="New Feed")
    assert got["content_text"].endswith("more of it.") and one(lib.table("feeds"), name="New Feed")["fulltext_ratio"] == 1.0
    lib.delete_feed_source(mine[0])
    assert one(lib.table("feeds"), id=mine[0]) is None
    lib.add_feed_category("My Own")
    lib.add_feed_category("my own")
    assert [r["id"] for r in lib.list_feed_categories().collect()] == ["my-own"]
    assert lib.sidebar().count() > 0 and lib.list_source_article_counts().count() > 0


def test_memory_books_settings(lib, tmp_path):
    lib.add_memory("word", "run", collocations=["run on"])
    lib.add_memory("word", " RUN ", definition="to move", collocations=["run on", "run in"])
    row = lib.list_memory(kind="word").first()
    assert lib.list_memory().count() == 1 and row["definition"] == "to move" and row["collocations_json"] == '["run on","run in"]'
    lib.set_memory_status(row["id"], "mastered")
    with pytest.raises(ValueError):
        lib.set_memory_status(row["id"], "lost")
    assert lib.list_memory(status="mastered").count() == 1
    lib.export_memory_csv(str(tmp_path / "csv"))
    (tmp_path / "b.txt").write_text("\n\n".join(f"CHAPTER {k}. Name\n\n" + "word " * 30 for k in range(1, 5)))
    for _ in range(2):
        lib.import_book(str(tmp_path / "b.txt"), "A Book", "https://books.example/77")
    assert lib.table("articles").filter("source = 'A Book'").count() == 4
    middle = one(lib.table("articles"), source="A Book", chapter_no=2)
    place = lib.book_position(middle["id"]).first()
    assert place["chapters"] == 4 and place["previous"] and place["next"]
    (tmp_path / "c.csv").write_text("Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n77,Text,1871-01-01,Middlemarch,en,Eliot,s,PR,b\n")
    lib.ensure_book_catalog(str(tmp_path / "c.csv"))
    assert lib.search_books("middle").first()["imported"]
    assert lib.once("k", lambda: None) and not lib.once("k", lambda: None) and lib.get_config(a="b")["a"] == "b"
    lib.backup_database(str(tmp_path / "copy"))
