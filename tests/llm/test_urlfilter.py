import pytest
from oracle import same_rows, views

from lectura.llm import queries, urlfilter


def judged(spark, *urls):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    return {r["url"]: r for r in urlfilter.filter_urls(df, queries.URL_RULES).collect()}


def test_rules(spark):
    rows = judged(spark, "http://a.com/x", "HTTP://WWW.Example.COM/en/1", "http://m.example.com/en/1", "http://x.net/es/1", "http://x.net/de/1", "http://com", "no scheme", None, "http://example.com/en?x", "http://notexample.com/en/1")
    assert [(rows[u]["rule"], rows[u]["verdict"]) for u in ("http://a.com/x", "HTTP://WWW.Example.COM/en/1", "http://m.example.com/en/1", "http://x.net/es/1")] == [("com/", "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block")]
    assert rows["http://x.net/de/1"]["rule"] is None and rows["http://com"]["rule"] is None and rows["http://example.com/en?x"]["rule"] == "com/" and rows["http://notexample.com/en/1"]["rule"] == "com/"
    assert (rows["no scheme"]["host"], rows[None]["host"], rows[None]["verdict"]) == ("", "", "allow")


@pytest.mark.parametrize(
    ("place", "hits"),
    [
        ("adult-x.org", (1, 0, 3)), ("adults.org", (1, 0, 3)), ("adulthood.org", (0, 0, 0)), ("spam-farm.org", (0, 2, 3)), ("spam-spam.org", (0, 1, 2)), ("sexton.org/sex", (1, 0, 3)), ("éadult.org", (0, 0, 0)), ("", (0, 0, 0)),
        ("free" * 5000, (0, 0, 0)), ("casinos-online.org", (1, 0, 3)), ("freeporn.org", (1, 0, 3)), ("pornhaus.org", (1, 0, 3)), ("unpornlike.org", (0, 0, 0)), ("hot-springs.org/free-map", (0, 2, 2)), ("specialists.org", (0, 0, 0)),
        ("free-bonus-download.org", (0, 3, 3)), ("poker.org", (0, 1, 2)), ("poker.org/gratis", (0, 2, 3)), ("bets", (0, 1, 1)), ("betss", (0, 0, 0)),
    ],
)
def test_vocabulary(place, hits):
    assert urlfilter.vocabulary_hits(place, urlfilter._automaton(urlfilter.WEIGHTS, urlfilter.STEMS)) == hits


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://porn.org/x", "a", "b")], "weight long, url string, judged string, host string")
    assert urlfilter.filter_urls(df, queries.URL_RULES).select("weight", "host", "judged", "verdict").collect() == [(3, "porn.org", "a", "block")]


def test_vocabulary_same_as_sql(spark, tmp_path):
    import duckdb

    words = [*urlfilter.WEIGHTS, *urlfilter.STEMS]
    urls = [f"http://{a}{w}{b}.org/{words[k - 1]}{c}" for k, w in enumerate(words) for a, b, c in (("", "", ""), ("x", "s", "-s"), ("a-", "s", "s"), ("", "sx", "x"), ("é", "-", "ß"))]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    mine, theirs = same_rows(queries.op2_url_filter(spark, str(tmp_path)), db.sql(queries.oracle_sql()["op2_url_filter"]))
    assert mine == theirs and mine


def test_same_as_sql(spark, small):
    mine, theirs = same_rows(queries.op2_url_filter(spark, small), views(small).sql(queries.oracle_sql()["op2_url_filter"]))
    assert mine == theirs and mine


def test_awkward_input(awkward, empty):
    df = awkward.withColumnRenamed("text", "url")
    rows = urlfilter.filter_urls(df, queries.URL_RULES).collect()
    assert len(rows) == 12 and {r["verdict"] for r in rows} == {"allow"}
    assert urlfilter.filter_urls(empty.withColumnRenamed("text", "url"), queries.URL_RULES).count() == 0
