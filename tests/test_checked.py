"""Loads that keep rejected lines with their reasons."""

from __future__ import annotations

from lectura.sources import checked


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def reasons(df):
    return {r["line"]: r["reason"] for r in df.collect()}


def test_words(spark):
    given = ['{"term":" Run ","cefr":"A1","rank":5}', '{"term":"run","cefr":"B1","rank":9}', '{"term":"x","cefr":"Z9","rank":1}', '{"term":"y","cefr":"A1","rank":0}', '{"term":"z","cefr":"A1"}', '{"cefr":"A1","rank":3}', "no json", "", None]
    judged = checked.lexicon_lines(lines(spark, *given))
    assert reasons(judged) == dict(zip(given, [None, "repeated", "unknown_level", "no_rank", "no_rank", "no_term", "not_json", "not_json", "not_json"], strict=True))
    good, rejects = checked.parted(judged, "term", "cefr", "rank")
    assert [tuple(r) for r in good.collect()] == [("run", "A1", 5)] and rejects.count() == 8


def test_phrases(spark):
    given = ['["Give  up","放弃","stop","phrasal",["formal"]]', '["give up","","","nonsense","none"]', '["word","","","idiom",[]]', '["","","","",[]]', "[]", "{", '["state-of-the-art"]']
    judged = checked.chunk_lines(lines(spark, *given))
    found = {r["line"]: r for r in judged.collect()}
    assert [found[g]["reason"] for g in given[2:6]] == ["one_word", "no_key", "no_key", "not_json"]
    assert sorted(found[g]["reason"] or "" for g in given[:2]) == ["", "repeated"]
    assert (found[given[6]]["type"], found[given[6]]["labels"], found[given[6]]["zh"], found[given[6]]["reason"]) == ("collocation", [], None, None)
    row = found[given[0]]
    assert (row["key"], row["zh"], row["type"], row["labels"]) == ("give up", "放弃", "phrasal", ["formal"])


def test_details(spark):
    given = ['["run","go\\nmove","","","2","1","7","","I run.","我跑。","odd"]', '["run"]', '["","a","","","","","",""]', '["run"," \\n","","","","","",""]', '["run","","","","","","",""," ","x"]', "nothing", None, "[]"]
    judged = checked.detail_lines(lines(spark, *given))
    assert reasons(judged) == dict(zip(given, [None, "too_short", "no_word", "nothing_in_it", "nothing_in_it", "not_json", "not_json", "too_short"], strict=True))
    row = judged.filter("reason is null").first()
    assert (row["word"], row["senses"], row["collins"], row["oxford"], row["rank"], [tuple(e) for e in row["examples"]]) == ("run", ["go", "move"], 2, True, 7, [("I run.", "我跑。")])


def test_no_lines(spark):
    none = lines(spark, "x").limit(0)
    assert [f(none).count() for f in (checked.lexicon_lines, checked.chunk_lines, checked.detail_lines)] == [0, 0, 0]


def test_feeds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checked, "MOST_BYTES", 2000)
    files = {
        "rss.xml": "<?xml version='1.0'?><RSS><channel><title>A &amp; B</title><item><title>x</title></item><item/></channel></RSS>", "atom.xml": '<feed xmlns="a"><title type="text"><![CDATA[C]]></title><entry></entry></feed>', "none.xml": "<rss><channel><item><title>only an entry's</title></item></channel></rss>",
        "cut.xml": "<rss><channel><title>t</title><item>", "page.html": "<html><title>p</title></html>", "empty.xml": " \n\t", "large.xml": "<rss>" + "x" * 3000 + "</rss>",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    rows = {r["path"].rsplit("/", 1)[1]: (r["ok"], r["title"], r["entries"], r["error"]) for r in checked.probe_files(spark, str(tmp_path)).collect()}
    assert rows == {
        "rss.xml": (True, "A & B", 2, None), "atom.xml": (True, "C", 1, None), "none.xml": (True, None, 1, None), "cut.xml": (False, None, 0, "broken"), "page.html": (False, None, 0, "not_a_feed"), "empty.xml": (False, None, 0, "empty"), "large.xml": (False, None, 0, "too_large"),
    }
    assert checked.probed(spark.createDataFrame([(None, None, None)], "path string, length long, content string")).first()["error"] == "empty"
