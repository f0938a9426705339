"""Readers and writers over small files."""

from __future__ import annotations

from lectura.sources import readers, writers


def test_rss_and_atom(spark, tmp_path):
    rss = tmp_path / "a.rss"
    rss.write_text("""<?xml version="1.0"?><rss><channel><title>c</title><item><title>One</title><link>http://a.example/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>short</description></item>
<item><guid>http://a.example/2</guid><description>only</description></item></channel></rss>""")
    rows = readers.rss(spark, str(rss)).orderBy("place").collect()
    assert [(r["title"], r["url"], r["body"]) for r in rows] == [("One", "http://a.example/1", "short"), ("Untitled", "http://a.example/2", "only")]
    assert rows[0]["published"].year == 2024 and rows[1]["published"] is None
    assert readers.validated(readers.rss(spark, str(rss))).first()["entries"] == 2
    atom = tmp_path / "b.atom"
    atom.write_text("""<feed><entry><title>T</title><link rel="self" href="http://x/s"/><link rel="alternate" href="http://x/a"/><id>i</id><updated>2024-01-02T00:00:00Z</updated><summary>s</summary></entry></feed>""")
    row = readers.atom(spark, str(atom)).first()
    assert (row["url"], row["body"], row["published"].day) == ("http://x/a", "s", 2)


def test_catalog(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n1,Text,1871-01-01,"Middle,  march",en,"Eliot, George, 1819-1880",s,PR,"Best; Category: Novels"\n2,Sound,1900-01-01,X,en,A,s,P,b\nx,Text,1,Y,en,A,s,P,b\n3,Text,1,Z,fr,A,s,P,b\n')
    rows = readers.catalog_csv(spark, str(path)).collect()
    assert [(r["gid"], r["title"], r["shelf"]) for r in rows] == [(1, "Middle, march", "Novels")]


def test_books_and_changes(spark, tmp_path):
    (tmp_path / "b.txt").write_text("\n\n".join(f"CHAPTER {k}. Name\n\n" + "word " * 30 for k in range(1, 5)))
    assert [r["title"] for r in readers.books(spark, str(tmp_path / "b.txt")).orderBy("number").collect()] == [f"Chapter {k} · Name" for k in range(1, 5)]
    seen = readers.changed_files(spark, str(tmp_path / "b.txt"), spark.createDataFrame([], "path string, hash string")).select("path", "hash")
    assert seen.count() == 1 and readers.changed_files(spark, str(tmp_path / "b.txt"), seen).count() == 0


def test_word_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('1\teng\tHe said "no".\n2\tcmn\t不\n')
    (tmp_path / "l.json").write_text('{"term":" Run ","cefr":"A1","rank":5}\n{"term":"x","cefr":"Z9","rank":5}\n{"term":"y","cefr":"A1","rank":0}\n')
    (tmp_path / "seed.json").write_text('[{"name":"A b","category":"c","url":"u"},{"name":null,"url":"v"}]')
    assert readers.sentences_tsv(spark, str(tmp_path / "s.tsv")).first()["text"] == 'He said "no".'
    assert [tuple(r) for r in readers.lexicon_json(spark, str(tmp_path / "l.json")).collect()] == [("run", "A1", 5)]
    assert [r["id"] for r in readers.seeds(spark, str(tmp_path / "seed.json")).collect()] == ["a-b"]


def test_memory_export(spark, tmp_path):
    rows = [("word", "=a", 'say "x"', "n", '["p","q"]', "@c", None, "learning", "2024-01-01 00:00:00")]
    memory = spark.createDataFrame(rows, "kind string, term string, definition string, word_type string, collocations_json string, context_sentence string, article_id string, status string, created_at string")
    writers.write_memory_csv(memory, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("﻿kind,term") and '"say ""x"""' in text and "'=a" in text and "p; q" in text and "'@c" in text


def test_dictionary_and_snapshot(spark, tmp_path):
    writers.write_dictionary(spark.createDataFrame([("b", 1), ("a", 2)], "word string, n int"), str(tmp_path / "d"))
    assert [r["word"] for r in spark.read.json(str(tmp_path / "d")).collect()] == ["a", "b"]
    writers.write_snapshot(spark.range(3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
