"""Single expressions and small row changes as queries of their own."""

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import gates, prose, reflow, scoring
from ..functions import text as T
from ..operators import enrich, lexical, merge, ranking, stats
from ..streaming import ingest
from . import library as L
from .analysis import _ANY, _FNV_SQL, _GATED_SQL, _LOW, _MERGED_SQL, _OLD_SQL, _OUTCOME_SQL, _TOK_SQL, _terms_sql, outcomes
from .queries import _BOOKS_SQL, _PARA_SQL, NEEDS_SQL, books, paragraphs, translations
from .registry import query

# --- gates one by one ------------------------------------------------------------------------------------------------


def _gate(name: str, sql: str, make) -> None:
    @query(name, f"with {_GATED_SQL} select id, {sql} as v from gated", ("entries",))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return L.entries(spark, d).select("id", make(F.col("title"), F.col("content_text")).alias("v"))


_gate("t3_truncated", "cut", lambda t, c: gates.looks_truncated(c))
_gate("t7_chrome", "chrome", lambda t, c: gates.looks_like_chrome(c))

_LISTED_SQL = "case when number % 3 = 0 then replace(content_text, chr(10), chr(10) || '- [link](x) ') when number % 3 = 1 then replace(content_text, chr(10), chr(10) || '2. [a] ' || chr(10) || 'plain ') else content_text end"


@query("t8_link_dump", f"""with l as (select id, list_filter(string_split(regexp_replace({_LISTED_SQL}, '(^|{chr(10)})\\[\\d+\\]:\\s+\\S+[ \\t]*', '', 'g'), chr(10)), lambda x: trim(x) <> '') as lines from entries)
 select id, len(lines) >= 8 and 2 * len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*([-*]|\\d+\\.)\\s+\\['))) >= len(lines) as v from l""", ("entries",))
def t8_link_dump(spark: SparkSession, d: str) -> DataFrame:
    """Bodies whose lines are all, half, or not at all list items with links."""
    n, body = F.col("number") % 3, F.col("content_text")
    listed = F.when(n == 0, F.replace(body, F.lit("\n"), F.lit("\n- [link](x) "))).when(n == 1, F.replace(body, F.lit("\n"), F.lit("\n2. [a] \nplain "))).otherwise(body)
    return L.entries(spark, d).select("id", gates.is_link_dump(listed).alias("v"))


_gate("t12_prose_chars", "prose", lambda t, c: gates.prose_chars(c).cast("long"))
_gate("t13_paywall", "paywall", lambda t, c: gates.looks_like_paywall(c))
_gate("t11_blocked", "round_title or links::double / greatest(words, 1) * 1000 > 80 or transcript", lambda t, c: gates.is_blocked(t, c))
_gate("t6_full_text", "length(content_text) >= 2000 and prose >= 200 and not chrome and not cut and words >= 400", lambda t, c: gates.is_full_text(c, F.lit(gates.TRUST_CHARS)))


@query("t15_choose_body", f"with {_GATED_SQL} select id, case when number % 2 = 0 and prose >= 200 and not chrome and not cut and words >= 400 then 'page' when prose >= 200 and not chrome and not cut and words >= 400 then 'own' end as chosen from gated", ("entries",))
def t15_choose_body(spark: SparkSession, d: str) -> DataFrame:
    own, fetched = F.col("content_text"), F.col("number") % 2 == 0
    chosen = gates.choose_body(own, F.when(fetched, own))
    return L.entries(spark, d).select("id", F.when(chosen.isNotNull(), F.when(fetched, "page").otherwise("own")).alias("chosen"))


@query("t17_title_tokens", "select id, array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') as tokens from articles", ("articles",))
def t17_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", F.array_join(T.title_tokens(F.col("title")), " ").alias("tokens"))


_OUTCOMES = ("accepted", "blocked", "known", "nav_or_links", "not_english", "old", "paywall", "shell", "too_short", "truncated")
_BY_SOURCE_SQL = f"with {_GATED_SQL}, told as (select source, {_OUTCOME_SQL} as outcome from gated) select source, " + ", ".join(f"count(*) filter (outcome = '{x}') as {x}" for x in _OUTCOMES) + " from told group by source"


@query("a17_outcome_by_source", _BY_SOURCE_SQL, ("entries",))
def a17_outcome_by_source(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).groupBy("source").pivot("outcome", list(_OUTCOMES)).count().fillna(0)


@query("p17_language_gate", f"with {_GATED_SQL} select lang, count(*) filter ({_ANY(_LOW.format('left(content_text, 480)'), gates.CHROME_MARKERS)}) as chrome, count(*) as n from gated group by lang", ("entries",))
def p17_language_gate(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(spark, d).groupBy("lang").agg(F.count_if(gates.looks_like_chrome(F.col("content_text"))).alias("chrome"), F.count(F.lit(1)).alias("n"))


# --- row changes -----------------------------------------------------------------------------------------------------


@query("m9_once", "select 'once-' || event_type as key, min(event_id)::varchar as value from events group by event_type")
def m9_once(spark: SparkSession, d: str) -> DataFrame:
    """Run-once guards: of all who ask for a key the first one gets it, and who asks again finds it taken."""
    asked = L.table(spark, d, "events").groupBy(F.concat(F.lit("once-"), F.col("event_type")).alias("key")).agg(F.min("event_id").cast("string").alias("value"))
    taken = merge.insert_if_new(asked.limit(0), asked, "key")
    again = merge.insert_if_new(taken, L.table(spark, d, "events").select(F.concat(F.lit("once-"), F.col("event_type")).alias("key"), F.lit("late").alias("value")).distinct(), "key")
    return taken.unionByName(again.select("key", "value"))


@query("m11_enable_feed", "select id, case when id = 'feed-src4' then true else enabled end as enabled, case when id = 'feed-src4' then timestamp '2024-01-31 00:00:00' else last_new_article_at end as clock from feeds", ("feeds",))
def m11_enable_feed(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("id") == "feed-src4"
    return L.feeds(spark, d).select("id", F.when(own, True).otherwise(F.col("enabled")).alias("enabled"), F.when(own, L.now_column()).otherwise(F.col("last_new_article_at")).alias("clock"))


@query("m12_refresh_meta", "select f.id, coalesce(case when hash(f.id) is not null and regexp_extract(f.name, '([0-9]+)$', 1)::int % 2 = 0 then 0.5 end, f.fulltext_ratio) as ratio from feeds f", ("feeds",))
def m12_refresh_meta(spark: SparkSession, d: str) -> DataFrame:
    feeds = L.feeds(spark, d)
    new = feeds.select("id", F.when(F.regexp_extract("name", "([0-9]+)$", 1).cast("int") % 2 == 0, 0.5).alias("new_ratio"))
    return feeds.join(new, "id", "left").select("id", F.coalesce("new_ratio", "fulltext_ratio").alias("ratio"))


@query("m13_subscribe", "with n as (select id, name, url from feeds union all select 'feed-src1-' || left(md5('https://new.example/rss'), 8), 'feed src1', 'https://new.example/rss') select * from n", ("feeds",))
def m13_subscribe(spark: SparkSession, d: str) -> DataFrame:
    feeds = L.feeds(spark, d).select("id", "name", "url")
    wanted = spark.createDataFrame([("feed src1", "https://new.example/rss"), ("again", "https://example.com/src2/rss")], "name string, url string")
    new = wanted.join(feeds.select("url"), "url", "left_anti").withColumn("id", T.slug(F.col("name")))
    taken = feeds.select(F.col("id").alias("taken")).distinct()
    new = new.join(taken, F.col("id") == F.col("taken"), "left").withColumn("id", F.when(F.col("taken").isNotNull(), F.concat("id", F.lit("-"), F.left(F.md5("url"), F.lit(8)))).otherwise(F.col("id")))
    return feeds.unionByName(new.select("id", "name", "url"))


@query("m14_delete_feed", "select id from feeds where not (id in ('feed-src3', 'feed-src1') and (origin = 'user' or kind = 'book'))", ("feeds",))
def m14_delete_feed(spark: SparkSession, d: str) -> DataFrame:
    asked = F.col("id").isin("feed-src3", "feed-src1")
    return L.feeds(spark, d).filter(~(asked & ((F.col("origin") == "user") | (F.col("kind") == "book")))).select("id")


@query("m15_add_category", "select lower(r_name) as id, r_name as label from region union all select 'my-own', 'My own'")
def m15_add_category(spark: SparkSession, d: str) -> DataFrame:
    known = L.table(spark, d, "region").select(T.slug(F.col("r_name")).alias("id"), F.col("r_name").alias("label"))
    known = known.withColumn("id", F.lower("label"))
    new = spark.createDataFrame([("My own",)], "label string").select(T.slug(F.col("label")).alias("id"), "label")
    return known.unionByName(merge.insert_if_new(known, new, "id").select("id", "label"))


@query("m16_status", "select m.id, case when w.status in ('learning', 'mastered') then w.status else m.status end as status from memory m left join (select 'm' || user_id as id, arg_max(case event_type when 'view' then 'mastered' when 'click' then 'learning' else event_type end, {'t': ts, 'e': event_id}) as status from events group by user_id) w using (id)", ("memory",))
def m16_status(spark: SparkSession, d: str) -> DataFrame:
    """The last status that events ask for each saved word; one that isn't allowed changes nothing."""
    wanted = F.when(F.col("event_type") == "view", "mastered").when(F.col("event_type") == "click", "learning").otherwise(F.col("event_type"))
    asked = L.table(spark, d, "events").groupBy(F.concat(F.lit("m"), F.col("user_id")).alias("id")).agg(F.max_by(wanted, F.struct("ts", "event_id")).alias("wanted"))
    return L.memory(spark, d).join(asked, "id", "left").select("id", F.when(F.col("wanted").isin("learning", "mastered"), F.col("wanted")).otherwise(F.col("status")).alias("status"))


@query("m17_deletes", f"with {_PARA_SQL} select count(*) as n from tr where article_id <> '11'", ("articles",))
def m17_deletes(spark: SparkSession, d: str) -> DataFrame:
    return translations(spark, d).filter(~((F.col("article_id") == "11") & (F.col("scope") == "paragraph"))).agg(F.count(F.lit(1)).alias("n"))


@query("snk4_meta", "select user_id::varchar as key, arg_max(event_type, {'t': ts, 'e': event_id}) as value from events group by user_id")
def snk4_meta(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))


@query("snk8_chunks", "select id, ((row_number() over (partition by source order by number) - 1) // 10)::int as chunk from articles", ("articles",))
def snk8_chunks(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy("number"))
    return L.articles(spark, d, reading=False).select("id", F.expr("0").alias("z"), place.alias("p")).select("id", ((F.col("p") - 1) / 10).cast("int").alias("chunk"))


@query("d8_first_upgrade", "select source, min(number) as number from articles where word_count >= 400 group by source", ("articles",))
def d8_first_upgrade(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy("number"))
    return L.articles(spark, d, reading=False).filter("word_count >= 400").withColumn("r", place).filter("r = 1").select("source", "number")


@query("d4_term_union", f"select id, len(list_distinct(list_concat({_terms_sql('title')}, {_terms_sql('left(content_text, 6000)')}))) as n from articles", ("articles",))
def d4_term_union(spark: SparkSession, d: str) -> DataFrame:
    return ranking.with_terms(L.articles(spark, d, reading=False)).select("id", F.size("terms").cast("long").alias("n"))


@query("a10_document_frequency", f"with t as (select id, unnest(list_distinct(list_concat({_terms_sql('title')}, {_terms_sql('left(content_text, 6000)')}))) as term from articles) select term, count(*) as df, round(greatest(ln((1.0 + (select count(*) from articles)) / (1.0 + count(*))), 0), 9) as idf from t group by term", ("articles",))
def a10_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    a = L.articles(spark, d, reading=False)
    df = ranking.with_terms(a).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = a.agg(F.count(F.lit(1)).alias("docs"))
    return df.crossJoin(F.broadcast(size)).select("term", "df", F.round(F.greatest(F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))), F.lit(0.0)), 9).alias("idf"))


@query("a19_existing_chapters", "select source, count(*) > 0 as there, count(*) as n from articles where origin = 'book' group by source", ("articles",))
def a19_existing_chapters(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return L.articles(spark, d, reading=False).filter("origin = 'book'").groupBy("source").agg((n > 0).alias("there"), n.alias("n"))


@query("a20_match_counters", f"with w as (select distinct unnest({_TOK_SQL.format('title')}) as term from articles where lang = 'en') select count(*) as words, count(l.term) as matched from w left join lexicon l using (term)", ("articles", "lexicon"))
def a20_match_counters(spark: SparkSession, d: str) -> DataFrame:
    words = L.articles(spark, d, reading=False).filter("lang = 'en'").select(F.explode(T.difficulty_tokens(F.col("title"))).alias("term")).distinct()
    return words.join(L.lexicon(spark, d).select("term", F.lit(1).alias("k")), "term", "left").agg(F.count(F.lit(1)).alias("words"), F.count("k").alias("matched"))


@query("s9_longest_phrases", "select term, length(term) as n from memory where kind = 'phrase' order by n desc, term limit 20", ("memory",))
def s9_longest_phrases(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("term").cast("long")
    return L.memory(spark, d).filter("kind = 'phrase'").select("term", n.alias("n")).orderBy(F.desc("n"), "term").limit(20)


@query("s10_append_page", "select number from articles where number < 70", ("articles",))
def s10_append_page(spark: SparkSession, d: str) -> DataFrame:
    shown, page = L.articles(spark, d, reading=False).filter("number < 40").select("number"), L.articles(spark, d, reading=False).filter("number between 30 and 69").select("number")
    return shown.unionByName(page.join(shown, "number", "left_anti"))


_FLAT_SQL = """with g as (select category, list(id order by name) as ids from feeds group by category),
 n as (select category, case category when 'world' then list_concat([ids[3]], ids[1:2], ids[4:]) else ids end as ids from g),
 f as (select unnest(ids) as id, generate_subscripts(ids, 1) as nth, coalesce(list_position(['world', 'tech', 'finance', 'other', 'book'], category), 6) as section, category from n)
 select id, row_number() over (order by section, category, nth) as place from f where id is not null"""


@query("s11_flat_order", _FLAT_SQL, ("feeds",))
def s11_flat_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of all feeds after the third of one category was drawn to its top."""
    feeds = L.feeds(spark, d).select("id", "category", F.col("name").alias("pos"))
    return stats.moved(feeds, ["world", "tech", "finance", "other", "book"], "world", 2, 0).select("id", "place")


# --- headings, parts: window forms -----------------------------------------------------------------------------------

_LINES_SQL = "li as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from documents), hd as (select *, length(line) between 1 and 40 as head from li)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = L.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return lines.withColumn("head", F.char_length("line").between(1, 40))


@query("w6_heading_runs", f"with {_LINES_SQL}, h as (select *, coalesce(idx - lag(idx) over (partition by doc_id order by idx) > 1, false)::int as new from hd where head), r as (select *, sum(new) over (partition by doc_id order by idx) as island from h) select doc_id, island::bigint as island, count(*) as n, min(idx)::int as first from r group by doc_id, island having count(*) >= 4")
def w6_heading_runs(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("idx")
    heads = _lines(spark, d).filter("head").withColumn("new", F.coalesce(F.col("idx") - F.lag("idx").over(order) > 1, F.lit(False)).cast("int"))
    runs = heads.withColumn("island", F.sum("new").over(order)).groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return runs.filter(F.col("n") >= prose.TOC_RUN)


@query("w9_sections", f"with {_LINES_SQL}, s as (select *, sum(head::int) over (partition by doc_id order by idx) as section from hd) select doc_id, section::bigint as section, count(*) as lines, min(idx)::int as first from s group by doc_id, section")
def w9_sections(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("idx")
    return _lines(spark, d).withColumn("section", F.sum(F.col("head").cast("int")).over(order)).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.min("idx").alias("first"))


@query("w8_parts", "with li as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\\S+'))) as w from documents), f as (select doc_id, list_reduce(list_prepend([0, 8000], list_transform(w, lambda n: [n, -1])), lambda s, x: case when s[2] >= 8000 then [s[1] + 1, x[1]] else [s[1], s[2] + x[1]] end) as r from li) select doc_id, r[1]::bigint as parts from f")
def w8_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that are closed by the line with which they reach 8,000 words: a fold over the lines' counts."""
    counts = F.transform(F.split("text", "\n"), lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).cast("long"))
    pair = lambda p, w: F.struct(p.alias("parts"), w.alias("words"))
    most = F.lit(prose.PART_WORDS).cast("long")
    step = lambda s, n: F.when(s["words"] >= most, pair(s["parts"] + 1, n)).otherwise(pair(s["parts"], s["words"] + n))
    folded = F.aggregate(counts, pair(F.lit(0).cast("long"), most), step, lambda s: s["parts"])
    return L.table(spark, d, "documents").select("doc_id", folded.alias("parts"))


# --- text kernels one by one ------------------------------------------------------------------------------------------


def _kernel(name: str, expression, joined: bool = False) -> None:
    @query(name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = expression(F.col("content_text"))
        return L.entries(spark, d).select("id", (F.array_join(found, "\n\n") if joined else found.cast("string")).alias("text"))


_kernel("t21_strip_links", reflow.strip_links)
_kernel("t22_rejoin_hyphens", reflow.rejoin_hyphens)
_kernel("t23_normal_paragraph", reflow.normal_paragraph)
_kernel("t25_add_spaces", reflow.add_spaces)
_kernel("t24_split_block", reflow.split_block, joined=True)
_kernel("t26_sentence_ends", reflow.sentence_ends)
_kernel("t27_split_long", reflow.split_long, joined=True)
_kernel("t29_t30_book_blocks", reflow.book_blocks, joined=True)


@query("t31_heading_title")
def t31_heading_title(spark: SparkSession, d: str) -> DataFrame:
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: (prose.heading_title(t.split("\n")[0]) or ("", False))[0])

    return L.entries(spark, d).select("id", F.pandas_udf(each, StringType())("content_text").alias("text"))


# --- words ------------------------------------------------------------------------------------------------------------


@query("l1_keys", "select id, regexp_replace(lower(trim(title)), '\\s+', ' ', 'g') as key from articles", ("articles",))
def l1_keys(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", lexical.normal_key(F.col("title")).alias("key"))


@query("l9_phrase_keys")
def l9_phrase_keys(spark: SparkSession, d: str) -> DataFrame:
    return lexical.phrase_keys(L.memory(spark, d).select(F.col("term").alias("phrase")), L.lexicon(spark, d))


@query("l15_l16_levels", """with t as (select id, list_filter(regexp_extract_all(lower(left(content_text, 6000)), '[a-z][a-z''-]*'), lambda x: length(x) >= 2) as tokens, len(regexp_extract_all(left(content_text, 6000), '[^.!?]+[.!?]*')) as s from articles where lang = 'en'),
 c as (select id, any_value(s) as s, count(*) as n, count(*) filter (coalesce(rank > 1000, true)) as rare from (select id, s, unnest(tokens) as term from t) left join lexicon using (term) group by id), f as (select id, n::double / greatest(s, 1) as x, rare::double / n / 5 as score from c),
 v as (select id, round(score * case when x <= 0 then 1 else least(1.25, greatest(0.9, 1 + 0.15 * ((x - 18) / 18.0))) end, 9) as v from f) select id, v, case when v < 0.02 then 'easy' when v < 0.05 then 'normal' when v < 0.1 then 'hard' when v < 0.18 then 'harder' else 'hardest' end as level from v""", ("articles", "lexicon"))
def l15_l16_levels(spark: SparkSession, d: str) -> DataFrame:
    """English articles' level by their share of words beyond rank 1,000 and the length of their sentences."""
    t = T.excerpt(F.col("content_text"))
    # sentences are counted once a text: beside an explode they would be counted again for every word
    texts = L.articles(spark, d, reading=False).filter("lang = 'en'").select("id", F.regexp_count(t, F.lit(r"[^.!?]+[.!?]*")).alias("s"), T.difficulty_tokens(t).alias("terms"))
    common = L.first_words(spark, d, 1000).withColumn("common", F.lit(True))
    words = texts.select("id", "s", F.explode("terms").alias("term")).join(F.broadcast(common), "term", "left")  # 1,000 words
    c = words.groupBy("id").agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("common").isNull()).alias("rare"))
    v = F.round(F.col("rare") / F.col("n") / 5 * scoring.sentence_factor(F.col("n") / F.greatest(F.col("s"), F.lit(1))), 9)
    return c.select("id", v.alias("v"), scoring.level_of(v).alias("level"))


@query("n5_jitter", f"select id, round(({_FNV_SQL}::ubigint % 1000)::double / 999.0 * 0.6 - 0.3, 9) as jitter from (select id, id || ':' || (epoch(timestamp '2024-01-31 00:00:00')::bigint // 86400 + {scoring.EPOCH_DAYS}) as x from articles)", ("articles",))
def n5_jitter(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", F.round(scoring.jitter(F.col("id"), scoring.day_key(L.now_column())), 9).alias("jitter"))


# --- enrichment, streams ----------------------------------------------------------------------------------------------


@query("u2_card_backfill")
def u2_card_backfill(spark: SparkSession, d: str) -> DataFrame:
    queue = L.articles(spark, d, reading=False).filter((F.trim("summary") == "") & (F.col("origin") != "book")).orderBy(F.desc("fetched_at"), "id").limit(200)
    return enrich.enriched(queue.select("id", "title"), "title", lambda items: [x[:60].title() for x in items], "card")


@query("u3_translate_missing", f"with {_PARA_SQL}, v as (select p.*, t.translated_text from para p left join tr t on p.article_id = t.article_id and p.idx::varchar = t.scope_key and p.text = t.source_text) select article_id, idx, coalesce(translated_text, '» ' || text) as translation from v", ("articles",))
def u3_translate_missing(spark: SparkSession, d: str) -> DataFrame:
    """Cached translations where they are valid, the model for the rest, each distinct text asked once a batch."""
    parts = paragraphs(spark, d)
    valid = merge.valid_translations(parts, translations(spark, d)).select("article_id", "idx", "translated_text")
    joined = parts.join(valid, ["article_id", "idx"])
    asked = enrich.enriched(joined.filter("translated_text is null").drop("translated_text"), "text", lambda items: ["» " + x for x in items], "translated_text", batch=8)
    return joined.filter("translated_text is not null").unionByName(asked).select("article_id", "idx", F.col("translated_text").alias("translation"))


@query("u4_single_flight", f"with {_PARA_SQL}, v as (select distinct p.article_id, p.idx::varchar as scope_key, p.text as source_text, t.translated_text from para p left join tr t on p.article_id = t.article_id and p.idx::varchar = t.scope_key and p.text = t.source_text) select article_id, scope_key, coalesce(translated_text, '» ' || source_text) as translated_text, translated_text is null as fresh from v", ("articles",))
def u4_single_flight(spark: SparkSession, d: str) -> DataFrame:
    """All paragraphs wanted twice: valid translations as they are, each other text asked for once."""
    wanted = paragraphs(spark, d).select("article_id", F.lit("paragraph").alias("scope"), F.col("idx").cast("string").alias("scope_key"), F.col("text").alias("source_text"))
    made = enrich.translated(wanted.unionByName(wanted), translations(spark, d), enrich.patient(lambda items: ["» " + x for x in items]))
    return made.select("article_id", "scope_key", "translated_text", "fresh")


def _told(items: list[str]) -> list[str]:
    """Stands for an outside model: fenced JSON with fields made from what is asked."""
    asked = [json.loads(x) for x in items]
    return ["```json\n" + json.dumps({"definition": "told " + x["context"], "word_type": "" if x["kind"] == "phrase" else "noun", "collocations": [x["term"] + " of"]}) + "\n```" for x in asked]


@query("u8_memory_fields", f"with {_OLD_SQL}, new as (select kind, k, term, 'told ' || context_sentence as definition, case kind when 'phrase' then 'phrase' else 'noun' end as word_type, case kind when 'phrase' then [] else [term || ' of'] end as list from old where {NEEDS_SQL}) {_MERGED_SQL}", ("memory",))
def u8_memory_fields(spark: SparkSession, d: str) -> DataFrame:
    saved = L.memory(spark, d).withColumn("collocations", merge.json_list(F.col("collocations_json")))
    return enrich.enriched_memory(saved, enrich.patient(_told)).withColumn("collocations", F.array_join("collocations", "; "))


@query("u5_engine_route", "select r_regionkey, case r_regionkey when 0 then 'local' when 1 then 'api' when 2 then 'local' else 'auto' end as engine from region")
def u5_engine_route(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    provider = F.lower(F.trim(F.when(k == 0, " Apple ").when(k == 1, "LLM").when(k == 2, "system").otherwise("?")))
    return L.table(spark, d, "region").select("r_regionkey", F.when(provider.isin("apple", "system", "local"), "local").when(provider.isin("api", "llm"), "api").otherwise("auto").alias("engine"))


@query("st6_completion", "select user_id as article_id, bool_or(event_type = 'purchase' or (event_type = 'signup' and floor(value * 1000) >= 15000)) as completed from events group by user_id")
def st6_completion(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "events")
    beats = e.select(F.col("user_id").alias("article_id"), F.floor(F.col("value") * 1000).cast("long").alias("delta_ms"), (F.col("event_type") == "purchase").alias("bottom"), (F.col("event_type") == "signup").alias("short"))
    return ingest.reading_time(beats).select("article_id", "completed")


@query("p14_books_by_decade", _BOOKS_SQL + "select left(issued, 4)::int // 10 * 10 as decade, count(*) as n from books group by decade")
def p14_books_by_decade(spark: SparkSession, d: str) -> DataFrame:
    decade = (F.floor(F.left("issued", F.lit(4)).cast("int") / 10) * 10).alias("decade")
    return books(spark, d).groupBy(decade).agg(F.count(F.lit(1)).alias("n"))
