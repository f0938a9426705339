"""Statistics, ranking, quality gates, row changes and lexical analysis over the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gates, scoring
from ..functions import text as T
from ..operators import lexical, listing, merge, ranking, stats
from . import library as L
from .queries import NEWEST_SQL, NOW_SQL, POOL_SQL, lookup_sql, pool
from .registry import query

# --- statistics ------------------------------------------------------------------------------------------------------


@query("a1_counts_by_source", "select source, count(*) as n from articles group by source", ("articles",))
def a1_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts_by_source(L.articles(spark, d, reading=False))


@query("a2_source_opens", "select source, sum(open_count)::bigint as opens from articles group by source having sum(open_count) > 0", ("articles",))
def a2_source_opens(spark: SparkSession, d: str) -> DataFrame:
    return stats.opens_by(L.articles(spark, d), "source")


@query("a2_category_opens", "select category, sum(open_count)::bigint as opens from articles group by category having sum(open_count) > 0", ("articles",))
def a2_category_opens(spark: SparkSession, d: str) -> DataFrame:
    return stats.opens_by(L.articles(spark, d), "category")


@query("a3_priority_max", "select category, max(priority) as priority from feeds where priority > 0 group by category", ("feeds",))
def a3_priority_max(spark: SparkSession, d: str) -> DataFrame:
    return L.feeds(spark, d).filter("priority > 0").groupBy("category").agg(F.max("priority").alias("priority"))


@query("a4_learning_stats", f"""select (select count(last_opened_at) from articles) as opened_total, (select count(*) from articles where last_opened_at::date = date '2024-01-31') as opened_today, (select count(*) from articles where last_opened_at >= {NOW_SQL} - to_days(7)) as opened_7d,
 (select count(*) from memory where kind = 'word' and created_at >= {NOW_SQL} - to_days(7)) as vocab_created_7d, (select count(*) from memory where kind = 'word' and status = 'learning') as vocab_learning,
 (select source from articles group by source having sum(open_count) > 0 order by sum(open_count) desc, source limit 1) as top_source, (select category from articles group by category having sum(open_count) > 0 order by sum(open_count) desc, category limit 1) as top_category""", ("articles", "memory"))
def a4_learning_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.learning_stats(L.articles(spark, d), L.memory(spark, d), L.now_column())


_DAILY_SQL = "daily as (select last_opened_at::date as day, count(*) as articles, sum(dwell_ms)::bigint as dwell_ms, sum(word_count)::bigint as words from articles where last_opened_at is not null group by day)"


@query("a5_daily", f"with {_DAILY_SQL} select * replace (day::varchar as day) from daily", ("articles",))
def a5_daily(spark: SparkSession, d: str) -> DataFrame:
    return stats.daily(L.articles(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("a6_daily_zero_filled", f"with {_DAILY_SQL}, days as (select unnest(generate_series(date '2024-01-18', date '2024-01-31', interval 1 day))::date as day) select d.day::varchar as day, coalesce(articles, 0) as articles, coalesce(dwell_ms, 0) // 60000 as minutes, coalesce(words, 0) as words from days d left join daily using (day)", ("articles",))
def a6_daily_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return stats.daily_series(spark, stats.daily(L.articles(spark, d)), F.lit("2024-01-31").cast("date")).withColumn("day", F.col("day").cast("string"))


@query("a7_totals", f"""with o as (select *, last_opened_at >= {NOW_SQL} - to_days(7) as week from articles) select count(last_opened_at) as opened, count(*) filter (week) as opened_7d, count(*) filter (read_completed) as completed, count(*) filter (liked) as liked,
 (coalesce(sum(dwell_ms) filter (last_opened_at is not null), 0)::bigint // 60000) as minutes, (coalesce(sum(dwell_ms) filter (week), 0)::bigint // 60000) as minutes_7d, coalesce(sum(word_count) filter (last_opened_at is not null), 0)::bigint as words from o""", ("articles",))
def a7_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.totals(L.articles(spark, d), L.now_column())


@query("a8_kind_status", "select kind, count(*) filter (status = 'learning') as learning, count(*) filter (status = 'mastered') as mastered from memory group by kind", ("memory",))
def a8_kind_status(spark: SparkSession, d: str) -> DataFrame:
    return stats.kind_by_status(L.memory(spark, d))


@query("a9_top_sources", "select source, count(*) as articles, sum(dwell_ms)::bigint // 60000 as minutes from articles where last_opened_at is not null group by source order by sum(dwell_ms) desc, count(*) desc, source limit 6", ("articles",))
def a9_top_sources(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_sources(L.articles(spark, d))


@query("a16_fulltext_ratio", "select source, avg((word_count >= 400)::int)::double as ratio from articles group by source", ("articles",))
def a16_fulltext_ratio(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).groupBy("source").agg(F.avg((F.col("word_count") >= gates.LEAST_WORDS).cast("int")).alias("ratio"))


@query("a18_chart_scale", f"with {_DAILY_SQL} select max(dwell_ms // 60000) as most, sum(dwell_ms // 60000)::bigint as minutes, sum(words)::bigint as words from daily", ("articles",))
def a18_chart_scale(spark: SparkSession, d: str) -> DataFrame:
    by = stats.daily(L.articles(spark, d)).withColumn("m", F.expr("dwell_ms div 60000"))
    return by.agg(F.max("m").alias("most"), F.sum("m").alias("minutes"), F.sum("words").alias("words"))


@query("w1_reorder_priority", "select id, category, count(*) over (partition by category) - row_number() over (partition by category order by name desc) + 1 as priority from feeds", ("feeds",))
def w1_reorder_priority(spark: SparkSession, d: str) -> DataFrame:
    wanted = L.feeds(spark, d).select("id", "category", "name").withColumn("pos", F.row_number().over(Window.orderBy(F.desc("name"))))
    return stats.reorder(wanted).select("id", "category", F.col("priority").cast("long").alias("priority"))


@query("w2_streak", f"with {_DAILY_SQL}, islands as (select min(day) as a, max(day) as b, count(*) as n from (select day, day - (row_number() over (order by day))::int as island from daily) group by island) select coalesce(max(n) filter (date '2024-01-31' - b in (0, 1)), 0) as streak from islands", ("articles",))
def w2_streak(spark: SparkSession, d: str) -> DataFrame:
    return stats.streak(stats.daily(L.articles(spark, d)), F.lit("2024-01-31").cast("date"))


@query("w5_top2_examples", """with s as (select doc_id, s, row_number() over () as x from (select doc_id, unnest(list_filter(string_split(text, '. '), lambda x: length(x) between 20 and 200)) as s from documents where lang = 'en' and doc_id < 1000000)),
 u as (select distinct s.s, doc_id from s), w as (select s, min(doc_id) as doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z][a-z''-]*'), lambda t: length(t) >= 2))) as word from u group by s), six as (select *, row_number() over (partition by word order by doc_id, s) as r from w),
 two as (select word, s, row_number() over (partition by word order by length(s), doc_id, s) as place from six where r <= 6) select word, s as example, place from two where place <= 2""")
def w5_top2_examples(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import etl

    docs = L.table(spark, d, "documents").filter("lang = 'en'")
    sentences = docs.select("doc_id", F.explode(F.filter(F.split("text", r"\. "), lambda s: F.char_length(s).between(20, 200))).alias("sentence"))
    return etl.examples(sentences.groupBy("sentence").agg(F.min("doc_id").alias("doc_id")))


@query("w7_first_n_per_feed", f"select id, source, r as place from (select id, source, row_number() over (partition by source order by {NEWEST_SQL}) as r from articles) where r <= 40", ("articles",))
def w7_first_n_per_feed(spark: SparkSession, d: str) -> DataFrame:
    return listing.first_per_group(L.articles(spark, d, reading=False), "source", listing.newest_first(), 40).select("id", "source", "place")


@query("s6_sidebar", """with c as (select source, count(*) as n from articles where number % 3 = 1 group by source) select f.id, case category when 'world' then 1 when 'tech' then 2 when 'finance' then 3 when 'other' then 4 when 'book' then 5 else 99 end as section, coalesce(n, 0) as n_items from feeds f left join c on c.source = f.name where coalesce(n, 0) > 0 or f.origin = 'user'""", ("feeds",))
def s6_sidebar(spark: SparkSession, d: str) -> DataFrame:
    counts = stats.counts_by_source(L.articles(spark, d, reading=False).filter("number % 3 = 1"))
    return listing.sidebar(L.feeds(spark, d), counts).select("id", F.col("section").cast("int").alias("section"), "n_items")


# --- ranking ---------------------------------------------------------------------------------------------------------

_FNV_SQL = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, length(x) + 1), lambda i: ascii(substr(x, i, 1))::uhugeint)), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
_WINDOW_SQL = f"win as (select * from articles order by {NEWEST_SQL} limit 500)"
_SCORED_SQL = f"""{_WINDOW_SQL}, so as (select source, sum(open_count)::double as n from articles group by source), co as (select category, sum(open_count)::double as n from articles group by category), cp as (select category, max(priority) as m from feeds group by category),
 joined as (select w.*, coalesce(so.n, 0) as s_n, coalesce(co.n, 0) as c_n, coalesce(f.priority, 0) as p, coalesce(cp.m, 0) as m, w.id || ':' || (19753 + 719163) as x, greatest(exp(-greatest(epoch({NOW_SQL} - coalesce(published_at, fetched_at)) / 86400.0, 0) / 21), 0.05) as fresh
  from win w left join so using (source) left join co using (category) left join feeds f on f.name = w.source left join cp on cp.category = w.category),
 scored as (select *, fresh * (1 + 0.6 * case when s_n <= 0 then 0 else ln(s_n + 1) / ln(10) end + 0.4 * case when c_n <= 0 then 0 else ln(c_n + 1) / ln(10) end + 1.5 * case when p <= 0 or m <= 0 then 0 else least(1, p / m) end) + case when liked then 2.5 else 0 end
  + case when word_count = 0 then 0 when word_count < 150 then -0.6 when word_count <= 3000 then 0.4 when word_count <= 6000 then 0.1 else -0.3 end
  + case when open_count = 0 then ({_FNV_SQL} % 1000)::double / 999.0 * 0.6 - 0.3 else case when read_completed then -0.6 else -0.25 end + case when dwell_ms >= 300000 then case when read_completed then 0.8 else 0.6 end when dwell_ms >= 30000 then 0.2 when dwell_ms > 0 and not read_completed then -0.15 else 0 end end as raw_score from joined)"""
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _terms_sql(column: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(lower({column}), '[^\\pL\\pN]+')), lambda t: length(t) >= 2 and not regexp_matches(t, '^[0-9]+$') and not list_contains({_STOP_SQL}, t))"


_RANKED_SQL = f"""{_SCORED_SQL}, terms as (select id, unnest(list_distinct(list_concat({_terms_sql("title")}, {_terms_sql("left(content_text, 6000)")}))) as term from win), df as (select term, count(*) as df from terms group by term),
 prof as (select term, sum(w) as w from (select unnest({_terms_sql("title")}) as term, case when liked then 2.0 else 1.0 end as w from articles where liked or read_completed) group by term),
 mass as (select term, w * greatest(ln((1.0 + (select count(*) from win)) / (1.0 + coalesce(df, 0))), 0) as mass from prof left join df using (term)), hit as (select id, sum(mass) as hit from terms join mass using (term) group by id),
 ranked as (select s.*, round(raw_score + case when (select sum(mass) from mass) > 0 then 0.8 * least(coalesce(hit, 0) / (select sum(mass) from mass), 1) else 0 end, 6) as rank_score from scored s left join hit using (id))"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """The newest 500 articles with their rank."""
    a = L.articles(spark, d)
    return ranking.ranked(listing.page(a, ranking.WINDOW), a, L.feeds(spark, d), L.now_column())


@query("t33_fnv", f"with k as (select doc_id, source || ':' || doc_id as x from documents) select doc_id, lpad(lower(to_hex({_FNV_SQL}::ubigint)), 16, '0') as hash from k")
def t33_fnv(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "documents").select("doc_id", T.fnv1a64_hex(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("hash"))


@query("n8_rank_score", f"with {_SCORED_SQL} select id, round(raw_score, 6) as rank_score from scored", ("feeds",))
def n8_rank_score(spark: SparkSession, d: str) -> DataFrame:
    a = L.articles(spark, d)
    return ranking.rank(listing.page(a, ranking.WINDOW), a, L.feeds(spark, d), L.now_column()).select("id", F.round("rank_score", 6).alias("rank_score"))


@query("a11_term_weights", f"select term, sum(w)::double as weight from (select unnest({_terms_sql('title')}) as term, case when liked then 2.0 else 1.0 end as w from articles where liked or read_completed) group by term", ("articles",))
def a11_term_weights(spark: SparkSession, d: str) -> DataFrame:
    return ranking.term_weights(L.articles(spark, d))


@query("n9_semantic_rank", f"with {_RANKED_SQL} select id, title, source, category, rank_score from ranked order by rank_score desc, id limit 60", ("feeds",))
def n9_semantic_rank(spark: SparkSession, d: str) -> DataFrame:
    return listing.keyset_page(ranked(spark, d), None, 0, 60).select("id", "title", "source", "category", "rank_score")


@query("s4_keyset_page", f"with {_RANKED_SQL}, c as (select id, rank_score from ranked order by rank_score desc, id limit 1 offset 29) select r.id, r.rank_score from ranked r, c where (r.rank_score < c.rank_score and abs(r.rank_score - c.rank_score) > 1e-9 * greatest(abs(r.rank_score), abs(c.rank_score), 1)) or (abs(r.rank_score - c.rank_score) <= 1e-9 * greatest(abs(r.rank_score), abs(c.rank_score), 1) and r.id > c.id) order by r.rank_score desc, r.id limit 30", ("feeds",))
def s4_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked(spark, d)
    last = listing.keyset_page(rows, None, 29, 1).select("rank_score", "id").first()
    return listing.keyset_page(rows, tuple(last) if last else None, 0, 30).select("id", "rank_score")


@query("w3_diversified", f"with {_RANKED_SQL}, u as (select *, row_number() over (partition by source, category = 'book' order by rank_score desc, id) as own from ranked where last_opened_at is null), v as (select *, row_number() over (partition by category order by rank_score desc, id) as place from u where category <> 'book' or own <= 3) select id, category, rank_score from v order by (place > 3)::int, rank_score desc, id limit 10", ("feeds",))
def w3_diversified(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diversified(ranked(spark, d)).select("id", "category", "rank_score")


@query("s5_difficulty_order", f"with {_RANKED_SQL}, l as (select *, ['easy', 'normal', 'hard', 'harder', 'hardest'][number % 6 + 1] as level from ranked) select id, level, round(rank_score + case level when 'normal' then 0.5 when 'hard' then 0.25 when 'easy' then 0.1 when 'harder' then -0.2 when 'hardest' then -0.5 else 0 end, 6) as adjusted from l order by adjusted desc, rank_score desc, id limit 60", ("feeds",))
def s5_difficulty_order(spark: SparkSession, d: str) -> DataFrame:
    levels = L.articles(spark, d).select("id", F.get(F.array(*map(F.lit, scoring.LEVELS)), (F.col("number") % 6).cast("int")).alias("level"))
    return ranking.by_difficulty(ranked(spark, d), levels).limit(60).select("id", "level", "adjusted")


@query("n1_n7_parts", f"select id, round(greatest(exp(-greatest(epoch({NOW_SQL} - published_at) / 86400.0, 0) / 21), 0.05), 9) as fresh, case when dwell_ms >= 300000 then case when read_completed then 0.8 else 0.6 end when dwell_ms >= 30000 then 0.2 when dwell_ms > 0 and not read_completed then -0.15 else 0.0 end::double as dwell from articles", ("articles",))
def n1_n7_parts(spark: SparkSession, d: str) -> DataFrame:
    fresh = scoring.freshness(scoring.age_days(F.col("published_at"), F.col("fetched_at"), L.now_column()))
    return L.articles(spark, d).select("id", F.round(fresh, 9).alias("fresh"), scoring.dwell_adjustment(F.col("dwell_ms"), F.col("read_completed")).alias("dwell"))


# --- gates and the refresh funnel ------------------------------------------------------------------------------------

_ANY = lambda column, markers: " or ".join(f"contains({column}, '{m}')" for m in markers)
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GATED_SQL = f"""gated as (select *, len(regexp_extract_all(content_text, '\\S+')) as words,
 length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content_text, '(?is)(?:Keywords for this article|Filed under:|^\\s*Tags:).*$', '', 'g'), '(?m)^\\[\\d+\\]:\\s+\\S+\\s*$', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', '', 'g')) as prose,
 ({_ANY(_LOW.format("left(content_text, 480)"), gates.CHROME_MARKERS)}) as chrome, ({_ANY(_LOW.format("right(content_text, 100)"), gates.TRUNCATION_MARKERS)}) as cut, ({_ANY(_LOW.format("content_text"), gates.PAYWALL_MARKERS)}) as paywall,
 len(regexp_extract_all(content_text, 'https?://')) as links, regexp_matches(title, '{gates.ROUNDUP}') as round_title, regexp_matches(title, '{gates.TRANSCRIPT}') or len(regexp_extract_all(content_text, '{gates.TIMESTAMP}')) >= 20 as transcript,
 len(regexp_extract_all(title || ' ' || left(content_text, 1200), '\\pL')) as letters, len(regexp_extract_all(title || ' ' || left(content_text, 1200), '[A-Za-z]')) as latin from entries)"""
_REASON_SQL = "case when prose < 200 then 'shell' when chrome then 'nav_or_links' when cut then 'truncated' when words < 400 then 'too_short' end"


@query("t5_reject_reason", f"with {_GATED_SQL} select id, {_REASON_SQL} as reason, prose as prose_chars from gated", ("entries",))
def t5_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("content_text")
    return L.entries(spark, d).select("id", gates.reject_reason(body).alias("reason"), gates.prose_chars(body).cast("long").alias("prose_chars"))


@query("t9_link_density", f"with {_GATED_SQL} select id, links::double / greatest(words, 1) * 1000 as density, round_title or links::double / greatest(words, 1) * 1000 > 80 as roundup from gated", ("entries",))
def t9_link_density(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(spark, d).select("id", gates.link_density(F.col("content_text")).alias("density"), gates.is_roundup(F.col("title"), F.col("content_text")).alias("roundup"))


@query("t10_transcript", f"with {_GATED_SQL} select id, transcript from gated", ("entries",))
def t10_transcript(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(spark, d).select("id", gates.is_transcript(F.col("title"), F.col("content_text")).alias("transcript"))


@query("t4_trust_bar", "select id, case when fulltext_ratio >= 0.7 then 1200 when fulltext_ratio between 0 and 0.2 then 3200 else 2000 end as bar from feeds", ("feeds",))
def t4_trust_bar(spark: SparkSession, d: str) -> DataFrame:
    return L.feeds(spark, d).select("id", gates.trust_chars(F.col("fulltext_ratio")).alias("bar"))


_ENGLISH_SQL = "(letters < 40 or ((letters - latin)::double / letters <= 0.12 and latin::double / letters >= 0.85))"


@query("t14_english", f"with {_GATED_SQL} select id, lang = 'en' as tag, {_ENGLISH_SQL} as script from gated", ("entries",))
def t14_english(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(spark, d).select("id", gates.is_english_tag(F.col("lang")).alias("tag"), gates.looks_english(F.col("title"), F.col("content_text")).alias("script"))


_OUTCOME_SQL = f"case when published_at < {NOW_SQL} - to_days(14) then 'old' when number % 5 = 0 then 'known' when {_REASON_SQL} is not null then {_REASON_SQL} when paywall then 'paywall' when not (lang = 'en' and {_ENGLISH_SQL}) then 'not_english' when round_title or links::double / greatest(words, 1) * 1000 > 80 or transcript then 'blocked' else 'accepted' end"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each entry with the first gate that stops it; cheap tests come first."""
    body, title = F.col("content_text"), F.col("title")
    old = F.col("published_at") < L.now_column() - F.make_dt_interval(days=F.lit(L.RETENTION_DAYS))
    reason = gates.reject_reason(body)
    return L.entries(spark, d).withColumn("outcome", F.when(old, "old").when(F.col("number") % 5 == 0, "known").when(reason.isNotNull(), reason).when(gates.looks_like_paywall(body), "paywall").when(~gates.is_english(F.col("lang"), title, body), "not_english").when(gates.is_blocked(title, body), "blocked").otherwise("accepted"))


@query("a17_funnel", f"with {_GATED_SQL} select {_OUTCOME_SQL} as outcome, count(*) as n from gated group by outcome", ("entries",))
def a17_funnel(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("st3_retention_filter", f"select count(*) as n from entries where published_at >= {NOW_SQL} - to_days(14)", ("entries",))
def st3_retention_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(spark, d).filter(F.col("published_at") >= L.now_column() - F.make_dt_interval(days=F.lit(14))).agg(F.count(F.lit(1)).alias("n"))


@query("t16_cannot_beat", "select id, strlen(content_text) + strlen(content_text) // 16 + 1024 <= length(content_text) + 1200 as skip from articles", ("articles",))
def t16_cannot_beat(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", gates.cannot_beat(F.octet_length("content_text"), F.char_length("content_text") + 1200).alias("skip"))


# --- row changes -----------------------------------------------------------------------------------------------------

_PROTECTED_SQL = "(origin <> 'rss' or liked or (last_opened_at is not null and not read_completed))"


@query("m5_retention", f"select id from articles where {_PROTECTED_SQL} or coalesce(published_at, fetched_at) >= {NOW_SQL} - to_days(14)", ("articles",))
def m5_retention(spark: SparkSession, d: str) -> DataFrame:
    return merge.retained(L.articles(spark, d), L.now_column(), 14).select("id")


@query("m6_short_purge", f"select id from articles where {_PROTECTED_SQL} or not (word_count > 0 and word_count < 400)", ("articles",))
def m6_short_purge(spark: SparkSession, d: str) -> DataFrame:
    return merge.without_short(L.articles(spark, d)).select("id")


@query("m7_blocked_purge", f"with {_GATED_SQL} select id from gated where {_PROTECTED_SQL} or not (round_title or links::double / greatest(words, 1) * 1000 > 80 or transcript)", ("entries",))
def m7_blocked_purge(spark: SparkSession, d: str) -> DataFrame:
    return merge.without_blocked(L.entries(spark, d, reading=True)).select("id")


@query("m8_word_counts", "select id, len(regexp_extract_all(content_text, '\\S+')) as word_count from articles where trim(content_text) <> ''", ("articles",))
def m8_word_counts(spark: SparkSession, d: str) -> DataFrame:
    unset = L.articles(spark, d, reading=False).withColumn("word_count", F.when(F.col("number") % 2 == 0, 0).otherwise(F.col("word_count")))
    return merge.with_word_counts(unset).select("id", "word_count")


@query("m10_stale_feeds", f"select id, enabled and not (kind <> 'book' and last_new_article_at < {NOW_SQL} - to_days(30)) as enabled from feeds", ("feeds",))
def m10_stale_feeds(spark: SparkSession, d: str) -> DataFrame:
    return merge.stale_feeds(L.feeds(spark, d), L.now_column()).select("id", "enabled")


@query("m1_mark_opened", "select user_id as article_id, max(ts) as last_opened_at, count(*) as open_count from events where event_type = 'view' group by user_id")
def m1_mark_opened(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("article_id")).agg(F.max("ts").alias("last_opened_at"), F.count(F.lit(1)).alias("open_count"))


@query("m2_progress", "with p as (select user_id, ts, event_id, greatest(least(floor(value * 2000)::bigint - 60000, 120000), -120000) as delta, event_type = 'purchase' as done from events), f as (select user_id as article_id, list_reduce(list_prepend(0, list(delta order by ts, event_id)), lambda s, x: greatest(0, s + x)) as dwell_ms, bool_or(done) as completed from p group by user_id) select * from f")
def m2_progress(spark: SparkSession, d: str) -> DataFrame:
    steps = L.table(spark, d, "events").select(F.col("user_id").alias("article_id"), "ts", "event_id", (F.floor(F.col("value") * 2000).cast("long") - 60_000).alias("delta"), (F.col("event_type") == "purchase").alias("done"))
    return merge.reading_progress(steps)


@query("m3_liked_latest", "select user_id as article_id, arg_max(event_type = 'click', {'t': ts, 'e': event_id}) as liked from events where event_type in ('click', 'error') group by user_id")
def m3_liked_latest(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "events").filter("event_type in ('click', 'error')").groupBy(F.col("user_id").alias("article_id")).agg(F.max_by(F.col("event_type") == "click", F.struct("ts", "event_id")).alias("liked"))


@query("m4_body_upgrade", """with new as (select id, case when number % 4 = 0 then content_text || ' longer' else content_text end as t from articles where number % 2 = 0) select a.id, length(coalesce(n.t, a.content_text)) as chars, a.origin = 'rss' and n.t is not null and n.t <> a.content_text as invalidated from articles a left join new n on n.id = a.id and a.origin = 'rss'""", ("articles",))
def m4_body_upgrade(spark: SparkSession, d: str) -> DataFrame:
    a = L.articles(spark, d, reading=False)
    new = a.filter("number % 2 = 0").select(F.col("id").alias("new_id"), F.when(F.col("number") % 4 == 0, F.concat("content_text", F.lit(" longer"))).otherwise(F.col("content_text")).alias("t"))
    joined = a.join(new, (F.col("id") == F.col("new_id")) & (F.col("origin") == "rss"), "left")
    return joined.select("id", F.char_length(F.coalesce("t", "content_text")).cast("long").alias("chars"), (F.col("t").isNotNull() & (F.col("t") != F.col("content_text"))).alias("invalidated"))





@query("d3_seed_reconcile", """with f as (select *, regexp_extract(name, '([0-9]+)$', 1)::int as no from feeds), seed as (select id, 'seeded ' || name as name, category from f where no % 4 <> 0 union all select 'feed-new' || r_regionkey, r_name, 'world' from region)
 select s.id, s.name, case when f.id is null then 'added' else 'updated' end as change from seed s left join f using (id) union all select id, name, 'kept' from f where origin = 'user' and id not in (select id from seed)""", ("feeds",))
def d3_seed_reconcile(spark: SparkSession, d: str) -> DataFrame:
    feeds = L.feeds(spark, d).select("id", "name", "category", "enabled", "origin")
    own = feeds.filter(F.regexp_extract("name", "([0-9]+)$", 1).cast("int") % 4 != 0).select("id", F.concat(F.lit("seeded "), "name").alias("name"), "category")
    new = L.table(spark, d, "region").select(F.concat(F.lit("feed-new"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("world").alias("category"))
    return merge.reconcile(feeds, own.unionByName(new)).select("id", "name", "change")


@query("snk1_insert_if_new", "select url, title from articles where number % 2 = 1 and url not in (select url from articles where number % 6 = 1)", ("articles",))
def snk1_insert_if_new(spark: SparkSession, d: str) -> DataFrame:
    a = L.articles(spark, d, reading=False)
    new = a.filter("number % 2 = 1")
    return merge.insert_if_new(a.filter("number % 6 = 1"), new.unionByName(new)).select("url", "title")


@query("snk2_upsert_latest", "select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def snk2_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    best = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "event_type", "ts").orderBy(F.desc("event_id")))).filter("r = 1").drop("r")
    return merge.upsert_latest(best.filter("event_id % 2 = 0"), best.filter("event_id % 2 = 1"), ["user_id", "event_type"], "ts")


@query("d6_array_merge", "select 'm' || rank as id, case when rank % 2 = 0 then term || ' on; in use; new' else 'new; in use' end as merged from lexicon where rank between 50 and 249", ("memory",))
def d6_array_merge(spark: SparkSession, d: str) -> DataFrame:
    new = F.array(F.lit(" new "), F.lit(""), F.lit("in use"))
    return L.memory(spark, d).select("id", F.array_join(merge.merged_list(merge.json_list(F.col("collocations_json")), new), "; ").alias("merged"))


_OLD_SQL = "old as (select kind, term, definition, word_type, context_sentence, created_at, lower(trim(term)) as k, case when starts_with(collocations_json, '[\"') then [term.split(' ')[1] || ' on', 'in use'] else [] end as list from memory)"
_MERGED_SQL = """select kind, coalesce(o.term, n.term) as term, coalesce(nullif(o.definition, ''), n.definition, o.definition) as definition,
 case when coalesce(o.word_type, '') in ('', 'phrase') then coalesce(nullif(n.word_type, ''), o.word_type) else o.word_type end as word_type,
 array_to_string(list_concat(coalesce(o.list, []), coalesce(n.list, [])), '; ') as collocations from old o full join new n using (kind, k)"""


@query("d7_memory_merge", f"with {_OLD_SQL}, new as (select kind, k, upper(term) as term, 'new gloss' as definition, 'v' as word_type, ['new'] as list from old where created_at > timestamp '2024-01-25 00:00:00' union all select 'word', 'brandnew', 'brandnew', 'fresh', '', ['x']) {_MERGED_SQL}", ("memory",))
def d7_memory_merge(spark: SparkSession, d: str) -> DataFrame:
    m = L.memory(spark, d).withColumn("collocations", merge.json_list(F.col("collocations_json")))
    new = m.filter("created_at > timestamp_ntz '2024-01-25 00:00:00'").select("kind", F.upper("term").alias("term"), F.lit("new gloss").alias("definition"), F.lit("v").alias("word_type"), F.array(F.lit("new")).alias("collocations"))
    more = spark.createDataFrame([("word", "brandnew", "fresh", "", ["x"])], new.schema)
    return merge.merge_memory(m, new.unionByName(more)).withColumn("collocations", F.array_join("collocations", "; "))


@query("d9_union_terms", "select term from memory where kind = 'word' and status = 'learning' union all select term from memory where kind = 'phrase' and status = 'learning'", ("memory",))
def d9_union_terms(spark: SparkSession, d: str) -> DataFrame:
    m = L.memory(spark, d).filter("status = 'learning'")
    return m.filter("kind = 'word'").select("term").unionByName(m.filter("kind = 'phrase'").select("term"))


@query("d10_feed_partition", "select kind, count(*) as n from feeds group by kind", ("feeds",))
def d10_feed_partition(spark: SparkSession, d: str) -> DataFrame:
    f = L.feeds(spark, d)
    return f.filter("kind <> 'book'").unionByName(f.filter("kind = 'book'")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- words and levels ------------------------------------------------------------------------------------------------

_TOK_SQL = "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z''-]*'), lambda t: length(t) >= 2)"


@query("l13_tokens", f"select id, len({_TOK_SQL.format('content_text')}) as n, len(list_distinct({_TOK_SQL.format('content_text')})) as d from articles", ("articles",))
def l13_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.difficulty_tokens(F.col("content_text"))
    return L.articles(spark, d, reading=False).select("id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("d"))


@query("l18_content_terms", f"select id, array_to_string(list_sort({_terms_sql('title')}), ' ') as terms from articles", ("articles",))
def l18_content_terms(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", F.array_join(F.array_sort(T.content_terms(F.col("title"))), " ").alias("terms"))


_IRREGULAR_SQL = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in lexical.IRREGULAR.items()) + "}"
_LEMMAS_SQL = f"""with {lookup_sql("select term from lexicon", "select term, rank from lexicon where rank % 2 = 0")},
 based as (select t.term, arg_min(form, place) as base from tried t join lexicon l on l.term = t.form where place > 0 and l.rank % 2 = 0 group by t.term),
 likely as (select term, arg_min(form, place) as form from tried where place > 0 group by term),
 own as (select term from lexicon where rank % 2 = 0)
 select a.term, coalesce({_IRREGULAR_SQL}[a.term], base, case when a.term not in (select term from own) then form end, a.term) as lemma from asked a left join based using (term) left join likely using (term)"""


@query("l2_lemma_lookup", _LEMMAS_SQL, ("lexicon",))
def l2_lemma_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The base forms of all words by a lexicon of every second one, so that unknown words occur too."""
    lex = L.lexicon(spark, d)
    return lexical.lemmas(lex.select("term"), lex.filter("rank % 2 = 0"))


_WEIGHT_SQL = "case when rank <= 1000 then 0 when rank <= 3000 then 0 when rank <= 5000 then 1 when rank <= 10000 then 2 else 3 end"


@query("l14_word_weight", f"select term, rank, case when {_WEIGHT_SQL} = 0 then 0.0 else 1 + 0.5 * {_WEIGHT_SQL} end::double as weight from lexicon", ("lexicon",))
def l14_word_weight(spark: SparkSession, d: str) -> DataFrame:
    return L.lexicon(spark, d).select("term", "rank", scoring.word_weight(F.col("rank"), F.lit(False), F.lit(False)).alias("weight"))


@query("l20_lexicon", "select term, n, rank from lexicon", ("lexicon",))
def l20_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return L.lexicon(spark, d)


def scores(spark: SparkSession, d: str) -> DataFrame:
    return lexical.difficulty(L.articles(spark, d, reading=False), L.lexicon(spark, d), L.memory(spark, d).filter("status = 'learning'"))


@query("l17_difficulty")
def l17_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d)


_CHEAP_SQL = f"cheap as (select id, round(len(list_filter({_TOK_SQL.format('content_text')}, lambda t: length(t) >= 9))::double / greatest(len({_TOK_SQL.format('content_text')}), 1), 6) as score from articles)"


def _cheap(spark: SparkSession, d: str) -> DataFrame:
    """The share of long words, as scores that SQL can compute too."""
    t = T.difficulty_tokens(F.col("content_text"))
    return L.articles(spark, d, reading=False).select("id", F.round(F.size(F.filter(t, lambda x: F.char_length(x) >= 9)) / F.greatest(F.size(t), F.lit(1)), 6).alias("score"))


_EDGES_SQL = f"{_CHEAP_SQL}, q as (select quantile_cont(score, [0.15, 0.4, 0.7, 0.9]) as q from cheap), e as (select q[1] * 0.5 + 0.01 as a, q[2] * 0.5 + 0.025 as b, q[3] * 0.5 + 0.05 as c, q[4] * 0.5 + 0.09 as d from q), e1 as (select greatest(a, 0.001) as a, b, c, d from e), e2 as (select a, greatest(b, a + 0.001) as b, c, d from e1), e3 as (select a, b, greatest(c, b + 0.001) as c, d from e2), edges as (select round(a, 6) as e1, round(b, 6) as e2, round(c, 6) as e3, round(greatest(d, c + 0.001), 6) as e4 from e3)"


@query("a13_edges", f"with {_EDGES_SQL} select * from edges", ("articles",))
def a13_edges(spark: SparkSession, d: str) -> DataFrame:
    return lexical.calibrated_edges(_cheap(spark, d)).select(*(F.get("edges", F.lit(k)).alias(f"e{k + 1}") for k in range(4)))


@query("a14_level_counts", f"with {_EDGES_SQL} select case when score < e1 then 'easy' when score < e2 then 'normal' when score < e3 then 'hard' when score < e4 then 'harder' else 'hardest' end as level, count(*) as n from cheap, edges group by level", ("articles",))
def a14_level_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _cheap(spark, d)
    return lexical.with_levels(s, lexical.calibrated_edges(s)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


_MIDS = [(scoring.BANDS[k] * scoring.BANDS[k + 1]) ** 0.5 for k in range(4)]
_PLACED_SQL = f"""with recursive numbered as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, 400 + value * 100 as difficulty, event_type <> 'error' as correct from events),
 answered as (select *, 1 - (n - 1) / {lexical.QUESTIONS}.0::double as decay from numbered where n <= {lexical.QUESTIONS}),
 placed as (select distinct user_id, 0::bigint as n, {lexical.START}::double as ability from answered
  union all select a.user_id, a.n, greatest({lexical.LOW}, least({lexical.HIGH}, 0.7 * p.ability * case when correct then 1 + 0.18 * decay else 1 - 0.22 * decay end + 0.3 * difficulty * case when correct then 1.15 else 0.75 end))::double
  from placed p join answered a on a.user_id = p.user_id and a.n = p.n + 1),
 ended as (select user_id, arg_max(ability, n) as ability from placed group by user_id)
 select user_id, round(ability, 6) as ability, case {" ".join(f"when ability < {m!r} then {b}" for m, b in zip(_MIDS, scoring.BANDS, strict=False))} else {scoring.BANDS[-1]} end as band,
 case {" ".join(f"when ability < {m!r} then '{v}'" for m, v in zip(_MIDS, ("A2", "B1", "B2", "C1"), strict=True))} else 'C2' end as level from ended"""


@query("n10_placement_ability", _PLACED_SQL)
def n10_placement_ability(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    answers = e.withColumn("n", number).filter(F.col("n") <= lexical.QUESTIONS).select("user_id", "n", (400 + F.col("value") * 100).alias("difficulty"), (F.col("event_type") != "error").alias("correct"))
    return lexical.placement(answers)


@query("s7_knn_items", f"select term, rank, round(abs(ln(greatest(rank, 1)) - ln(3000.0)), 9) as distance from ({POOL_SQL}) order by distance, rank limit 25", ("lexicon",))
def s7_knn_items(spark: SparkSession, d: str) -> DataFrame:
    return lexical.nearest_items(pool(spark, d), 3000.0).select("term", "rank", "distance")


@query("s8_distractors", f"with p as (select term, rank, 'gloss ' || (rank % 997) as gloss from ({POOL_SQL})), o as (select *, abs(rank - 2500) as distance, row_number() over (partition by gloss order by abs(rank - 2500), rank) as r from p where rank <> 2500 and gloss <> 'gloss ' || (2500 % 997)) select term, rank, gloss, distance from o where r = 1 order by distance, rank limit 3", ("lexicon",))
def s8_distractors(spark: SparkSession, d: str) -> DataFrame:
    return lexical.distractors(pool(spark, d), 2500).select("term", "rank", "gloss", "distance")


# --- hard words, names, phrases ----------------------------------------------------------------------------------------


@query("l5_hard_words", "with c as (select term, rank, greatest(case when rank <= 1000 then 0 when rank <= 3000 then 1 when rank <= 5000 then 2 when rank <= 10000 then 3 when rank <= 20000 then 4 else 5 end - 2, 0) as steps from lexicon) select term, rank, steps::int as steps, steps > 0 or rank > 3000 as hard, steps >= 2 as super_hard from c", ("lexicon",))
def l5_hard_words(spark: SparkSession, d: str) -> DataFrame:
    return lexical.hard_words(L.lexicon(spark, d)).select("term", "rank", "steps", "hard", "super_hard")


@query("l6_hard_outside", """with t as (select distinct case when rank % 3 = 0 then term || '-' || lag(term) over (order by rank) when rank % 3 = 1 then term || '-zzz' else term || 'zzzz' end as term from lexicon where rank >= 2), p as (select term, unnest(list_filter(string_split(term, '-'), lambda x: x <> '')) as part from t where contains(term, '-')),
 k as (select p.term, count(*) as n, count(l.term) as known from p left join lexicon l on l.term = p.part group by p.term) select t.term, not coalesce(n >= 2 and n = known, false) and length(regexp_replace(t.term, '[^A-Za-z]', '', 'g')) >= 7 as hard from t left join k using (term)""", ("lexicon",))
def l6_hard_outside(spark: SparkSession, d: str) -> DataFrame:
    lex = L.lexicon(spark, d)
    r, before = F.col("rank"), F.when(F.col("rank") > 2, F.col("before"))
    made = lex.filter("rank >= 2").join(lex.select((F.col("rank") + 1).alias("rank"), F.col("term").alias("before")), "rank", "left").select(F.when(r % 3 == 0, F.concat("term", F.lit("-"), before)).when(r % 3 == 1, F.concat("term", F.lit("-zzz"))).otherwise(F.concat("term", F.lit("zzzz"))).alias("term"))
    return lexical.hard_outside(made, lex)


@query("l7_proper_nouns")
def l7_proper_nouns(spark: SparkSession, d: str) -> DataFrame:
    return lexical.proper_nouns(L.articles(spark, d, reading=False).filter("lang = 'en'").select("id", F.col("content_text").alias("text")))


@query("l8_name_glosses", "with g as (select rank, case rank % 4 when 0 then '人名' when 1 then '多义，第二义' when 2 then '单义' else '总统；人名' end as gloss from lexicon) select rank, gloss, rank % 4 in (0, 3) as names, case rank % 4 when 1 then null else gloss end as shown from g", ("lexicon",))
def l8_name_glosses(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rank")
    g = L.lexicon(spark, d).select("rank", F.when(r % 4 == 0, "人名").when(r % 4 == 1, "多义，第二义").when(r % 4 == 2, "单义").otherwise("总统；人名").alias("gloss"))
    return g.select("rank", "gloss", lexical.is_name_gloss(F.col("gloss")).alias("names"), lexical.name_gloss(F.col("gloss")).alias("shown"))


@query("l10_chunk_lookup")
def l10_chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    lex = L.lexicon(spark, d)
    chunks = L.memory(spark, d).filter("kind = 'phrase'").select(F.col("term").alias("phrase"))
    selected = chunks.select(F.concat(F.upper("phrase"), F.lit("s")).alias("phrase")).unionByName(chunks)
    return lexical.chunk_lookup(selected, chunks, lex)


@query("l11_spaced_aliases")
def l11_spaced_aliases(spark: SparkSession, d: str) -> DataFrame:
    lex = L.lexicon(spark, d)
    behind = lex.select((F.col("rank") - 1).alias("rank"), F.col("term").alias("behind"))
    paired = lex.join(behind, "rank").select(F.concat("term", F.lit("-"), "behind").alias("term"), "n", "rank")
    return lexical.spaced_aliases(lex.unionByName(paired))


@query("l19_details", "with r as (select term, rank from lexicon) select term as word, 2 as n_senses, case when rank % 2 = 0 then 'x' end as phonetic, rank % 6 as collins, rank % 2 = 1 as oxford, rank, (rank % 3)::int as n_examples from r", ("lexicon",))
def l19_details(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rank")
    fixed = [F.concat(F.lit(" "), "term"), F.lit("one\ntwo\n"), F.when(r % 2 == 0, "x").otherwise(""), F.lit(""), (r % 6).cast("string"), (r % 2).cast("string"), r.cast("string"), F.lit("")]
    tail = F.flatten(F.array_repeat(F.array(F.lit("en"), F.lit("zh")), (r % 3).cast("int")))
    rows = L.lexicon(spark, d).select(F.concat(F.array(*fixed), tail, F.array(F.lit("odd"))).alias("row"))
    return lexical.decoded_details(rows).select("word", F.size("senses").alias("n_senses"), "phonetic", "collins", "oxford", "rank", F.size("examples").alias("n_examples"))


@query("l21_wants_gloss", "select id, definition <> '' and (kind = 'phrase' or status = 'mastered') as wants from memory", ("memory",))
def l21_wants_gloss(spark: SparkSession, d: str) -> DataFrame:
    m = L.memory(spark, d)
    return m.select("id", lexical.wants_gloss(F.lit(True), F.col("definition"), F.col("kind") == "phrase", F.col("status") == "mastered", F.lit(True), F.lit(False)).alias("wants"))
