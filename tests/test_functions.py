"""Expressions and text kernels on single cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectura.functions import catalog, gates, prose, reflow, scoring
from lectura.functions import text as T
from lectura.operators import dedup, enrich, lexical, listing, merge, ranking, stats


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("url", "wanted"), [
    ("https://example.com/story?utm_source=rss&utm_medium=feed&id=7#more", "https://example.com/story?id=7"), ("https://Example.com/story/?fbclid=abc", "https://example.com/story"), ("mailto:a@b.c", "mailto:a@b.c"),
    ("not a url", "not a url"), ("http://a.b", "http://a.b/"), ("http://a.b/?x", "http://a.b/?x="),
])
def test_canonical_url(spark, url, wanted):
    assert value(spark, T.canonical_url(F.lit(url))) == wanted


@pytest.mark.parametrize("text", ["hello", "a1:738000", "字", ""])
def test_fnv(spark, text):
    h = 0xCBF29CE484222325
    for octet in text.encode():
        h = (h ^ octet) * 0x100000001B3 % 2**64
    assert value(spark, T.fnv1a64_hex(F.lit(text))) == f"{h:016x}"


def test_content_terms(spark):
    assert set(value(spark, T.content_terms(F.lit("The Fed holds rates steady in 2026, officials say")))) == {"fed", "holds", "rates", "steady", "officials"}


def test_words_of_any_script(spark):
    assert value(spark, T.word_count(F.lit("a　b  c"))) == 3
    assert value(spark, T.word_count(F.lit("  "))) == 0


@pytest.mark.parametrize(("ratio", "bar"), [(0.9, 1200), (0.7, 1200), (0.1, 3200), (0.0, 3200), (-1.0, 2000), (0.5, 2000)])
def test_trust(spark, ratio, bar):
    assert value(spark, gates.trust_chars(F.lit(ratio))) == bar


@pytest.mark.parametrize(("tag", "ok"), [("en", True), ("en-US", True), ("EN_GB", True), ("zh-CN", False), ("ja", False), ("pt-BR", False)])
def test_english_tag(spark, tag, ok):
    assert value(spark, gates.is_english_tag(F.lit(tag))) is ok


def test_english_script(spark):
    prose_text = "The quick brown fox jumps over the lazy dog again and again. " * 3
    assert value(spark, gates.is_english(F.lit(None).cast("string"), F.lit("t"), F.lit(prose_text)))
    assert not value(spark, gates.is_english(F.lit("fr"), F.lit("t"), F.lit(prose_text)))
    assert not value(spark, gates.is_english(F.lit(None).cast("string"), F.lit("标题"), F.lit("这是一个很长的中文句子" * 10)))


@pytest.mark.parametrize(("raw", "stored", "skip"), [(1500, 10000, True), (11000, 10000, False), (10000, 10000, False), (10000, 10000 + 1024 + 625, True)])
def test_cannot_beat(spark, raw, stored, skip):
    assert value(spark, gates.cannot_beat(F.lit(raw), F.lit(stored))) is skip


def test_body_defects(spark):
    words = "word " * 500
    assert value(spark, gates.reject_reason(F.lit("short"))) == "shell"
    assert value(spark, gates.reject_reason(F.lit(words))) is None
    assert value(spark, gates.reject_reason(F.lit(words + "Continue reading…"))) == "truncated"
    assert value(spark, gates.reject_reason(F.lit("Skip to content\n" + words))) == "nav_or_links"
    assert value(spark, gates.reject_reason(F.lit("word " * 100))) == "too_short"
    assert value(spark, gates.reject_reason(F.lit("\n".join("* [a link with words](http://a.example)" for _ in range(20))))) == "nav_or_links"
    assert value(spark, gates.is_blocked(F.lit("Weekly Links, 09/04/2026"), F.lit(words)))


@pytest.mark.parametrize(("raw", "shown"), [("Melville, Herman, 1819-1891", "Herman Melville"), ("Anonymous", "Anonymous"), ("Melville, Herman; Other, Ann", "Herman Melville"), ("", ""), ("A, B, C", "A, B, C")])
def test_author(spark, raw, shown):
    assert value(spark, catalog.display_author(F.lit(raw))) == shown


def test_shelf(spark):
    assert value(spark, catalog.shelf(F.lit("Best Books; Category: Novels; x"))) == "Novels"
    assert value(spark, catalog.shelf(F.lit("; Plain ;x"))) == "Plain"
    assert value(spark, catalog.shelf(F.lit(None).cast("string"))) == ""


def test_title_of_page(spark):
    assert value(spark, T.title_from_html(F.lit("<title>A long headline here | Site</title>"))) == "A long headline here"
    assert value(spark, T.title_from_html(F.lit("<title>Short - Site name</title>"))) == "Short - Site name"
    assert value(spark, T.title_from_html(F.lit("<p>x"))) is None


def test_html_text(spark):
    html = "<html><head><title>t</title></head><body><script>x<y</script><p>One &amp; two</p><!-- no --><ul><li>a<li>b</ul>end</body></html>"
    assert value(spark, T.html_to_text(F.lit(html))) == "One & two\n\n* a\n* b\n\nend"


def test_blocked_hosts(spark):
    for host, blocked in (("10.1.2.3", True), ("8.8.8.8", False), ("localhost", True), ("172.31.0.1", True), ("172.32.0.1", False), ("example.com", False)):
        assert value(spark, T.blocked_host(F.lit(host))) is blocked


def test_lemmas(spark):
    forms = lambda w: value(spark, lexical.lemma_candidates(F.lit(w)))
    assert "stop" in forms("stopped") and "study" in forms("studies") and "make" in forms("making") and "wolf" in forms("wolves")
    assert forms("as") == [] and forms("two words") == []
    assert value(spark, lexical.irregular(F.lit("children"))) == "child"


def test_sentence_factor(spark):
    assert value(spark, scoring.sentence_factor(F.lit(18.0))) == 1.0
    assert value(spark, scoring.sentence_factor(F.lit(1000.0))) == 1.25


def test_calibration(spark):
    few = spark.createDataFrame([(0.1,)] * 39, "score double")
    assert lexical.calibrated_edges(few).first()["edges"] == [0.02, 0.05, 0.10, 0.18]
    many = spark.createDataFrame([(k * 0.4 / 199,) for k in range(200)], "score double")
    edges = lexical.calibrated_edges(many).first()["edges"]
    assert edges == sorted(set(edges)) and edges[-1] != 0.18


# --- prose ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "wanted"), [
    ("One.\n\nTwo.", ["One.", "Two."]), ("exam-\nple", ["example"]), ("well-\nknown", ["well-known"]), ("state-of-the-\nart", ["state-of-the-art"]), ("It costs 3.14 dollars.", ["It costs 3.14 dollars."]), ("Mr.Smith came", ["Mr.Smith came"]),
    ("See example.com now", ["See example.com now"]), ("end.Next one", ["end. Next one"]), ("a -- b", ["a—b"]), ("wait . . . ok", ["wait… ok"]), ("“Hi”", ['"Hi"']), ("a b", ["a b"]), ("soft\nwrap here", ["soft wrap here"]), ("Done.\nNext line", ["Done.", "Next line"]),
    ("see [label](http://x.y/z) ok", ["see label ok"]), ("![alt](http://x.y/z.png) shown here", ["alt shown here"]), ("at https://example.com/a.", ["at."]), ("[name][1] is here with some words\n\n[1]: https://x.y/z", ["name is here with some words"]), ("Subscribe to our newsletter\n\nReal text stays.", ["Real text stays."]),
])
def test_reflow(spark, text, wanted):
    assert value(spark, reflow.reflow_column(F.lit(text))) == wanted


def test_long_blocks_are_regrouped(spark):
    text = "This is a sentence of some length that goes on for a while. " * 40
    parts = value(spark, reflow.reflow_column(F.lit(text)))
    assert len(parts) > 1 and " ".join(parts) == text.strip()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n[]()1:/-h", max_size=120))
def test_cleaning_again_changes_nothing(text):
    once = prose.clean_body(text)
    assert prose.clean_body(once) == once


def test_chapters():
    body = [b for k in range(1, 7) for b in (f"CHAPTER {k}. Of things", "word " * 50)]
    contents = [f"CHAPTER {k}. Of things" for k in range(1, 7)]
    found = prose.split_chapters([*contents, "a preface of words " * 40, *body, *["more " * 10] * 60])
    assert [t for t, _ in found] == ["Front Matter", *(f"Chapter {k} · Of things" for k in range(1, 7))]
    assert [t for t, _ in prose.split_chapters(["plain " * 5000, "text " * 5000, "rest"])] == ["Part 1", "Part 2"]
    assert prose.heading_title("CHAPTER 1. Loomings.") == ("Chapter 1 · Loomings", True)
    assert prose.split_chapters([]) == []


def test_book_text(spark):
    raw = "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\n\r\na para-\r\ngraph\r\n[Pg 12]\r\nmore\r\n\r\n***\r\nend\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"
    assert value(spark, reflow.book_blocks(F.lit(raw))) == ["a paragraph more", "end"]


# --- operators --------------------------------------------------------------------------------------------------------


def test_streak_and_reorder(spark):
    days = spark.createDataFrame([("2024-01-31", 1), ("2024-01-30", 2), ("2024-01-27", 1)], "day string, articles int").withColumn("day", F.to_date("day"))
    assert stats.streak(days, F.to_date(F.lit("2024-01-31"))).first()["streak"] == 2
    assert stats.streak(days, F.to_date(F.lit("2024-02-02"))).first()["streak"] == 0
    assert stats.streak(days.limit(0), F.to_date(F.lit("2024-02-02"))).first()["streak"] == 0
    feeds = spark.createDataFrame([("t1", "t", 1), ("t2", "t", 2), ("f1", "f", 3), ("f2", "f", 4)], "id string, category string, pos int")
    assert {r["id"]: r["priority"] for r in stats.reorder(feeds).collect()} == {"t1": 2, "t2": 1, "f1": 2, "f2": 1}


def test_keyset_page(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "id string, rank_score double")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(listing.keyset_page(rows, (2.0, "b"))) == ["c", "d"]
    assert ids(listing.keyset_page(rows, (2.0000000000000004, "b"))) == ["c", "d"]
    assert ids(listing.keyset_page(rows, None, 1, 2)) == ["b", "c"]


def test_diversified(spark):
    rows = [(f"w{k}", "world", "s", 10.0 - k) for k in range(4)] + [("t0", "tech", "s", 1.0), ("t1", "tech", "s", 0.9), ("f0", "finance", "s", 0.5)] + [(f"b{k:02}", "book", "one", 20.0 - k) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, category string, source string, rank_score double").withColumn("last_opened_at", F.lit(None).cast("timestamp"))
    picked = [r["category"] for r in ranking.diversified(df.filter("category <> 'book'"), 5).collect()]
    assert picked.count("world") == 3
    assert [r["category"] for r in ranking.diversified(df, 10).collect()].count("book") == 3


def test_titles(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, long), (2, long.upper()), (3, long.replace("seven", "7")), (4, "three word title"), (5, "three word titles"), (6, ""), (7, ""), (8, "three word title")]
    kept = {r["number"] for r in dedup.greedy_kept(spark.createDataFrame(rows, "number long, title string"), key="number").collect()}
    assert kept == {1, 4, 5, 6, 7}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_is_the_sequential_rule(spark, seed):
    import random

    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    base = [[rnd.choice(vocabulary) for _ in range(12)] for _ in range(4)]
    titles = []
    for _ in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            t[rnd.randrange(12)] = rnd.choice(vocabulary)
        titles.append(" ".join(t))
    kept: list[tuple[int, list[str]]] = []
    for k, t in enumerate(titles):
        mine = t.split()
        if not any(mine == o or len(set(mine) & set(o)) >= 0.85 * len(set(mine) | set(o)) for _, o in kept):
            kept.append((k, mine))
    got = {r["number"] for r in dedup.greedy_kept(spark.createDataFrame(list(enumerate(titles)), "number long, title string"), key="number").collect()}
    assert got == {k for k, _ in kept}


def test_batches_are_halved():
    def model(items):
        if len(items) > 4 or "bad" in items:
            raise ValueError
        return [x.upper() for x in items]

    items = [f"x{k}" for k in range(16)]
    assert enrich.run_with_split(items, model) == [x.upper() for x in items]
    assert enrich.run_with_split(["a", "bad", "c"], model) == ["A", None, "C"]
    assert enrich.run_with_split([], model) == []


def test_merge_memory(spark):
    schema = "kind string, term string, definition string, word_type string, collocations array<string>"
    stored = spark.createDataFrame([("word", "Run", "", "v", ["run on"]), ("phrase", "run up", "x", "phrase", [])], schema)
    new = spark.createDataFrame([("word", " run", "to move", "n", ["run on", " run in "]), ("phrase", "run up", "y", "idiom", ["z"]), ("word", "new", "d", "n", [])], schema)
    got = {r["term"].strip(): (r["definition"], r["word_type"], r["collocations"]) for r in merge.merge_memory(stored, new).collect()}
    assert got["Run"] == ("to move", "v", ["run on", "run in"]) and got["run up"] == ("x", "idiom", ["z"]) and got["new"] == ("d", "n", [])


def test_search_catalog(spark):
    rows = [(1, "Moby-Dick Study Guide", "Spark", "Ref"), (2, "The Moby-Dick Companion", "Bryant", "Ref"), (3, "Moby-Dick", "Melville", "Fiction"), (4, "Typee", "Melville", "Travel")]
    books = spark.createDataFrame(rows, "gid long, title string, authors string, shelf string")
    assert [r["gid"] for r in listing.search_catalog(books, "moby-dick").collect()] == [3, 1, 2]
    assert listing.search_catalog(books, "melville").count() == 2 and listing.search_catalog(books, "melville", shelf="Fiction").count() == 1 and listing.search_catalog(books, " ").count() == 0


def test_patience():
    import json

    def failing(*failures):
        left, pauses = list(failures), []

        def model(items):
            if left:
                raise left.pop(0)
            return list(items)

        return enrich.patient(model, sleep=pauses.append), pauses

    for failure in (TimeoutError(), ConnectionResetError(), json.JSONDecodeError("no", "", 0), enrich.Refused(429), enrich.Refused(503)):
        model, pauses = failing(failure, failure)
        assert model(["a"]) == ["a"] and pauses == [0.6, 1.2]
    for failure in (ValueError("no key"), enrich.Refused(401), enrich.Refused(404)):
        model, pauses = failing(failure)
        with pytest.raises(type(failure)):
            model(["a"])
        assert pauses == []
    model, pauses = failing(*[enrich.Refused(500)] * 3)
    with pytest.raises(enrich.Refused):
        model(["a"])
    assert pauses == [0.6, 1.2]


def test_asked_once(spark, tmp_path):
    def model(items):
        for x in items:
            with open(f"{tmp_path}/{x}", "a") as seen:
                seen.write("x")
        return [x.upper() for x in items]

    rows = [(k, "ab"[k % 2]) for k in range(40)] + [(40, None)]
    got = enrich.asked_once(spark.createDataFrame(rows, "id long, t string").repartition(8), "t", model).collect()
    assert {(r["id"], r["answer"]) for r in got} == {(k, t and t.upper()) for k, t in rows} and len(got) == 41
    assert sorted(f.read_text() for f in tmp_path.iterdir()) == ["x", "x"]


def test_memory_answers_that_are_no_json(spark):
    saved = spark.createDataFrame([("word", "a", "", "", ["x"], "c"), ("phrase", "b up", "", "phrase", [], "c"), ("word", "c", "said", "n", [], "c")], "kind string, term string, definition string, word_type string, collocations array<string>, context_sentence string")
    rows = {r["term"]: r for r in enrich.enriched_memory(saved, lambda items: ["{broken" for _ in items]).collect()}
    assert (rows["a"]["definition"], rows["a"]["word_type"], rows["b up"]["word_type"], len(rows)) == ("", "", "phrase", 3)
    told = lambda items: ['{"definition": "d", "word_type": "idiom", "collocations": ["y"]}' for _ in items]
    rows = {r["term"]: r for r in enrich.enriched_memory(saved, told).collect()}
    assert [(rows[t]["definition"], rows[t]["word_type"], rows[t]["collocations"]) for t in ("a", "b up", "c")] == [("d", "idiom", ["x", "y"]), ("d", "idiom", []), ("said", "n", [])]


@pytest.mark.parametrize(("start", "end"), [(0, 3), (3, 0), (1, 2), (2, 2), (0, 9), (9, 0)])
def test_moved(spark, start, end):
    rows = [(f"{c}{k}", c, k) for c in "xyz" for k in range(4)]
    wanted = [f"y{k}" for k in range(4)]
    if start < 4:
        wanted.insert(end, wanted.pop(start))
    got = stats.moved(spark.createDataFrame(rows, "id string, category string, pos long"), ["z", "y"], "y", start, end).orderBy("place").collect()
    assert [r["id"] for r in got] == [f"z{k}" for k in range(4)] + wanted + [f"x{k}" for k in range(4)]
