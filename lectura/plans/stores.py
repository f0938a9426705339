"""Tables with several writers, chunks that count one by one, refreshes with state, counters of a pass."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import child, dedup
from ..sources import checked
from ..sources.ledger import Ledger
from ..sources.versions import Versions
from ..streaming import refresh
from . import library as L
from .analysis import _GATED_SQL, _OUTCOME_SQL, outcomes
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{dedup.shared_root(spark)}/store-{uuid.uuid4().hex}"


@query("src2_two_writers", "select c_custkey as id, round(c_acctbal * case when c_custkey % 3 = 0 then 2 else 1 end + case when c_custkey % 2 = 0 then 10 else 0 end, 2) as balance from customer where c_custkey % 7 <> 0")
def src2_two_writers(spark: SparkSession, d: str) -> DataFrame:
    """Two writers start from one version: the slower one does its work again on what the faster one left."""
    path, schema = _folder(spark), "id long, balance double"
    slow, fast = (Versions(spark, path, schema, ["id"]) for _ in range(2))
    slow.replace(L.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))
    key, started = F.col("id"), []

    def doubled(df: DataFrame) -> DataFrame:
        return df.filter((key % 3 == 0) | (key % 7 == 0)).select("id", (F.col("balance") * 2).alias("balance"), (key % 7 == 0).alias("__gone"))

    def raised(df: DataFrame) -> DataFrame:
        if not started:
            started.append(fast.update(doubled))
        return df.filter(key % 2 == 0).withColumn("balance", F.col("balance") + 10)

    slow.update(raised)
    slow.compact()
    return fast.read().select("id", F.round("balance", 2).alias("balance"))


def _chunked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Articles written in chunks of 50 numbers: what counts when the run is stopped after three, and at its end."""
    ledger, looks = Ledger(spark, _folder(spark)), iter(range(99))
    rows = L.articles(spark, d, reading=False).select("id", "number", "url", "title")
    chunk = F.floor(F.col("number") / 50)
    ledger.write(rows, "first", chunk, stop=lambda: next(looks) >= 3)
    early = ledger.read()
    ledger.write(rows, "first", chunk)  # goes on
    ledger.write(rows, "first", chunk)  # and finds nothing left
    return early, ledger.read()


@query("snk8_committed", "select id, number, url, title from articles", ("articles",))
def snk8_committed(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d)[1]


@query("st8_stopped", "select id, number, url, title from articles where number // 50 - (select min(number // 50) from articles) < 3", ("articles",))
def st8_stopped(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d)[0]


_FETCH_SQL = """with e as (select source as feed, doc_id % 3 + 1 as round, length(text) as chars, doc_id, row_number() over (partition by source, doc_id % 3 order by doc_id) as place, timestamp '2024-01-01 00:00:00' + to_hours(doc_id::int % 700) as published, regexp_extract(source, '([0-9]+)$', 1)::int % 2 = 0 as same from documents),
 s as (select * from e where place <= 40), one as (select feed, any_value(same) as same, count(*) as n1, count(*) filter (chars >= 2000) as f1, max(published) as p1 from s where round = 1 group by feed), r1 as (select *, f1::double / n1 as q1 from one),
 two as (select r.feed, case when r.q1 >= 0.7 then 1200 when r.q1 <= 0.2 then 3200 else 2000 end as b2, count(*) as n2, count(*) filter (chars >= case when r.q1 >= 0.7 then 1200 when r.q1 <= 0.2 then 3200 else 2000 end) as f2, max(published) as p2 from r1 r join s on s.feed = r.feed and s.round = 2 where not r.same group by r.feed, r.q1),
 r2 as (select r1.*, b2, n2, f2, case when same then q1 else f2::double / n2 end as q2, case when same then p1 else greatest(p1, p2) end as pp2 from r1 left join two using (feed)),
 three as (select r.feed, r.q2, case when r.q2 >= 0.7 then 1200 when r.q2 <= 0.2 then 3200 else 2000 end as b3, r.pp2, count(*) as n3, count(*) filter (chars >= case when r.q2 >= 0.7 then 1200 when r.q2 <= 0.2 then 3200 else 2000 end) as f3, max(published) as p3 from r2 r join s on s.feed = r.feed and s.round = 3 group by r.feed, r.q2, r.pp2)
 select feed, 1 as round, 'changed' as status, n1 as entries, f1 as full_texts, 2000 as bar, q1 as ratio, p1 as newest from r1 union all select feed, 2, case when same then 'unchanged' else 'changed' end, case when same then 0 else n2 end, case when same then 0 else f2 end, case when same then null else b2 end, q2, pp2 from r2
 union all select feed, 3, 'changed', n3, f3, b3, f3::double / n3, greatest(pp2, p3) from three"""


@query("st4_refresh", _FETCH_SQL)
def st4_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Three refreshes of every source, one batch each; the second finds every other source unchanged."""
    folder = _folder(spark)
    docs, n = L.table(spark, d, "documents"), F.col("doc_id") % 3 + 1
    place = F.row_number().over(Window.partitionBy("source", "round").orderBy("doc_id")) - 1
    # the first entries of a feed only, as a feed has them: partial ranks before the shuffle keep it small
    found = docs.select(F.col("source").alias("feed"), "source", n.alias("round"), F.char_length("text").alias("chars"), "doc_id").withColumn("place", place).filter(F.col("place") < refresh.MOST_ENTRIES)
    hours = F.make_dt_interval(hours=(F.col("doc_id") % 700).cast("int"))
    found = found.withColumn("published", F.to_timestamp(F.lit("2024-01-01 00:00:00")) + hours)
    same = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 2 == 0
    schema = "feed string, fetched timestamp, tag string, place int, chars int, published timestamp"
    for round_ in (1, 2, 3):
        told = F.when(same & F.lit(round_ == 2), 1).otherwise(F.lit(round_))
        batch = found.filter(F.col("round") == round_).withColumns({"fetched": F.to_timestamp(F.lit(f"2024-02-0{round_} 00:00:00")), "tag": F.concat_ws("-", "source", told)})
        batch.select("feed", "fetched", "tag", "place", "chars", "published").write.mode("append").parquet(f"{folder}/in")
        run = refresh.refreshed(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.schema(refresh.OUTPUT).parquet(f"{folder}/out")
    return out.select("feed", F.dayofmonth("fetched").alias("round"), "status", "entries", "full_texts", "bar", "ratio", F.col("newest").cast("timestamp_ntz").alias("newest"))


@query("st7_counters", f"with {_GATED_SQL} select {_OUTCOME_SQL} as outcome, count(*) as n from gated group by outcome", ("entries",))
def st7_counters(spark: SparkSession, d: str) -> DataFrame:
    """The funnel's counters, taken while its accepted entries are written: one pass, no second scan."""
    names = ("accepted", "blocked", "known", "nav_or_links", "not_english", "old", "paywall", "shell", "too_short", "truncated")
    seen = Observation("funnel")
    told = outcomes(spark, d).observe(seen, *(F.count_if(F.col("outcome") == x).alias(x) for x in names))
    told.filter("outcome = 'accepted'").select("id", "url", "title", "content_text").write.parquet(f"{_folder(spark)}/accepted")
    return spark.createDataFrame([(k, v) for k, v in seen.get.items() if v], "outcome string, n long")


#: Answers every text with a mark in front of it.
_PROGRAM = "import json, sys\nfor line in sys.stdin:\n    q = json.loads(line)\n    print(json.dumps({'id': q['id'], 'text': '» ' + q['text']}), flush=True)\n"


@query("u6_child_engine", "select id, '» ' || title as translated from articles", ("articles",))
def u6_child_engine(spark: SparkSession, d: str) -> DataFrame:
    """Titles through a program that runs beside each task."""
    return child.through_child(L.articles(spark, d, reading=False).select("id", "title"), "title", (child.PYTHON, "-c", _PROGRAM), "translated").select("id", "translated")


_RANKED_SQL = """select term, rank, case when rank % 11 = 0 then 'not_json' when rank % 11 = 1 then 'no_term' when rank % 11 = 2 then 'unknown_level' when rank % 11 = 3 then 'no_rank' end as lexicon,
 case when rank % 11 = 0 then 'not_json' when rank % 11 = 1 then 'no_key' when rank % 11 = 2 then 'one_word' end as chunk, case when rank % 11 = 0 then 'not_json' when rank % 11 = 1 then 'too_short' when rank % 11 = 2 then 'no_word' when rank % 11 = 3 then 'nothing_in_it' end as detail from lexicon"""


@query("src12_checked_loads", f"with r as ({_RANKED_SQL}) select 'lexicon' as kind, case when lexicon is null then term end as word, lexicon as reason, count(*) as n from r group by all union all select 'chunk', case when chunk is null then term || ' up' end, chunk, count(*) from r group by all union all select 'detail', case when detail is null then term end, detail, count(*) from r group by all", ("lexicon",))
def src12_checked_loads(spark: SparkSession, d: str) -> DataFrame:
    """Word, phrase and detail lines of the whole lexicon with planted defects: good ones by name, others by reason."""
    r, bad = F.col("rank"), F.col("rank") % 11
    lex = L.lexicon(spark, d)
    word = F.to_json(F.struct(F.when(bad == 1, " ").otherwise(F.col("term")).alias("term"), F.when(bad == 2, "D1").otherwise("B1").alias("cefr"), F.when(bad == 3, "none").otherwise(r.cast("string")).alias("rank")))
    array = lambda *c: F.to_json(F.array(*c))
    chunk = array(F.when(bad == 1, "").when(bad == 2, F.translate("term", "-", "")).otherwise(F.concat("term", F.lit(" up"))), F.lit("zh"), F.lit(""), F.lit("rare"), F.lit("none"))
    detail = F.when(bad == 1, array(F.col("term"), F.lit("x"))).otherwise(array(F.when(bad == 2, " ").otherwise(F.col("term")), F.when(bad == 3, " \n").otherwise("one\ntwo"), *map(F.lit, ("", "", "1", "0", "5", ""))))
    lines = lambda c: lex.select(F.when(bad == 0, F.lit("{broken")).otherwise(c).alias("value"))
    told = (("lexicon", checked.lexicon_lines(lines(word)), "term"), ("chunk", checked.chunk_lines(lines(chunk)), "key"), ("detail", checked.detail_lines(lines(detail)), "word"))
    parts = [df.select(F.lit(kind).alias("kind"), F.when(F.col("reason").isNull(), F.col(key)).alias("word"), "reason") for kind, df, key in told]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "word", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("src7_probe", """with n as (select source, regexp_extract(source, '([0-9]+)$', 1)::int % 5 as k, least(count(*), 40) as n from documents group by source)
 select source as path, k > 2 as ok, case when k > 2 then 'Feed & ' || source end as title, case when k > 2 then n else 0 end as entries, case k when 0 then 'broken' when 1 then 'not_a_feed' when 2 then 'empty' end as error from n""")
def src7_probe(spark: SparkSession, d: str) -> DataFrame:
    """Every source as a feed of its first entries, some of them cut off, no feeds, or empty."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    few = L.table(spark, d, "documents").select("source", "doc_id").withColumn("place", place).filter("place <= 40")
    item = F.concat(F.lit("<item><title>Entry "), F.col("doc_id").cast("string"), F.lit("</title></item>"))
    feed = few.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(item)), "\n").alias("items"))
    k = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 5
    xml = F.concat(F.lit("<?xml version='1.0'?><rss><channel><title>Feed &amp; "), F.col("source"), F.lit("</title>"), F.col("items"), F.when(k == 0, "</chan").otherwise("</channel></rss>"))
    content = F.when(k == 1, "<html><title>page</title></html>").when(k == 2, " \n").otherwise(xml)
    return checked.probed(feed.select(F.col("source").alias("path"), F.octet_length(content).alias("length"), content.alias("content")))
