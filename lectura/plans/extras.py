"""Text kernels, pages, dictionary, streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prose, reflow, scoring
from ..functions import text as T
from ..operators import dedup, enrich, etl, phrases, stats
from ..sources import extraction, readers, writers
from ..streaming import ingest
from . import library as L
from .registry import query

# --- text ------------------------------------------------------------------------------------------------------------


@query("t1_html_text")
def t1_html_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.pages(L.table(spark, d, "pages").select("page_id", "html")).select("page_id", "page_title", "page_text")


@query("t2_title", """with t as (select page_id, trim(split_part(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), chr(10), 1)) as t from pages),
 a as (select page_id, t, case when contains(t, ' | ') and length(trim(split_part(t, ' | ', 1))) >= 8 then trim(split_part(t, ' | ', 1)) else t end as x from t), b as (select page_id, t, case when contains(x, ' — ') and length(trim(split_part(x, ' — ', 1))) >= 8 then trim(split_part(x, ' — ', 1)) else x end as x from a),
 c as (select page_id, t, case when contains(x, ' – ') and length(trim(split_part(x, ' – ', 1))) >= 8 then trim(split_part(x, ' – ', 1)) else x end as x from b) select page_id, case when t <> '' then case when contains(x, ' - ') and length(trim(split_part(x, ' - ', 1))) >= 8 then trim(split_part(x, ' - ', 1)) else x end end as title from c""")
def t2_title(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("page_id", T.title_from_html(F.col("html")).alias("title"))


@query("t14_page_language", "select page_id, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1, 'i') as lang from pages")
def t14_page_language(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("page_id", F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"))


@query("t18_slug", "select source, lower(source) || '-u' || lower(to_hex(233)) || 'x' as slug from (select distinct source from documents)")
def t18_slug(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "documents").select("source").distinct().select("source", T.slug(F.concat(F.lit(" "), F.upper("source"), F.lit(" _éx "))).alias("slug"))


@query("t19_collapse", "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as collapsed from documents")
def t19_collapse(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "documents").select("doc_id", T.collapse_spaces(F.col("text")).alias("collapsed"))


@query("t20_clean_body")
def t20_clean_body(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(spark, d).select("id", prose.clean_body_column("content_text").alias("body"))


@query("t28_paragraphs")
def t28_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", F.posexplode(reflow.reflow_column("content_text")).alias("idx", "paragraph"))


@query("t32_chapters")
def t32_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Books of up to 20 whole documents that stand together, divided again at the headings put between them."""
    block = F.concat(F.lit("CHAPTER "), F.col("number").cast("string"), F.lit(". Of "), F.col("source"), F.lit("\n\n"), F.col("content_text"))
    each = L.articles(spark, d, reading=False).select(F.floor(F.col("number") / 20).alias("book"), "number", block.alias("block"))
    book = each.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "block"))), lambda x: x["block"]), "\n\n").alias("raw"))
    return book.select("book", F.posexplode(reflow.chapters_column("raw")).alias("idx", "c")).select("book", "idx", "c.title", F.char_length("c.text").alias("chars"))


_SQL_SPANS = """cut as (select id, regexp_extract_all(content_text, '[A-Za-z][A-Za-z''’-]*') as w, regexp_split_to_array(content_text, '[A-Za-z][A-Za-z''’-]*') as g from articles where lang = 'en'),
 toks as (select id, i, replace(lower(w[i + 1]), '’', '''') as word, case when regexp_full_match(g[i + 2], '\\s+') then 1 else 0 end as joined from (select id, w, g, unnest(range(len(w))) as i from cut)),
 sized as (select key, split_part(key, ' ', 1) as first, len(string_split(key, ' ')) as n from phrases),
 begun as (select t.id, t.i, p.n, p.key from toks t join sized p on p.first = t.word),
 long as (select b.id, b.i, b.n, b.key from begun b join toks t on t.id = b.id and t.i >= b.i and t.i < b.i + b.n group by all having count(*) = b.n and sum(case when t.i < b.i + b.n - 1 then joined else 1 end) = b.n and string_agg(t.word, ' ' order by t.i) = b.key),
 best as (select id, i, max(n) as n, arg_max(key, n) as key from long group by all),
 linked as (select b.*, o.i as nxt, row_number() over (partition by b.id order by b.i) = 1 as head from best b asof left join best o on o.id = b.id and o.i >= b.i + b.n),
 taken as (select id, i, n, key, nxt from linked where head union all select l.id, l.i, l.n, l.key, l.nxt from taken t join linked l on l.id = t.id and l.i = t.nxt)"""


@query("j13_longest_phrases", "with recursive " + L.with_views("phrases", sql="")[5:] + ", " + _SQL_SPANS + " select id, i, n, key from taken")
def j13_longest_phrases(spark: SparkSession, d: str) -> DataFrame:
    texts = L.articles(spark, d, reading=False).filter("lang = 'en'").select("id", F.col("content_text").alias("text"))
    return phrases.longest_matches(texts, L.phrases(spark, d))


@query("l12_annotate", "with recursive " + L.with_views("phrases", "lexicon", sql="")[5:] + ", " + _SQL_SPANS + """,
 covered as (select id, unnest(range(i, i + n)) as i from taken), known as (select id, i, n, 'phrase' as type, key, null::int as rank from taken union all select t.id, t.i, 1, 'word', t.word, l.rank from toks t join lexicon l on l.term = t.word anti join covered c on c.id = t.id and c.i = t.i),
 ends as (select *, coalesce(lag(i + n) over (partition by id order by i), 0) as past, row_number() over (partition by id order by i) as k from known), tail as (select c.id, len(w) as i, 0 as n, 'text' as type, null::varchar as key, null::int as rank, coalesce(m.past, 0) as past, coalesce(m.k, 0) + 1 as k from cut c left join (select id, max(i + n) as past, max(k) as k from ends group by id) m using (id)),
 pieces as (select id, list_concat(flatten(list_transform(range(len(w)), lambda i: [g[i + 1], w[i + 1]])), [g[len(w) + 1]]) as p from cut), parts as (select * from ends union all select * from tail),
 spans as (select id, 2 * k as spot, 'text' as type, array_to_string(p[case when k = 1 then 1 else past * 2 + 1 end : case when n = 0 then len(p) else i * 2 + 1 end], '') as text, null::varchar as key, null::int as rank from parts join pieces using (id)
 union all select id, 2 * k + 1, type, array_to_string(p[i * 2 + 2 : (i + n) * 2], ''), key, rank from parts join pieces using (id) where n > 0)
 select id, (row_number() over (partition by id order by spot) - 1)::int as idx, type, text, key, rank from spans where text <> ''""")
def l12_annotate(spark: SparkSession, d: str) -> DataFrame:
    texts = L.articles(spark, d, reading=False).filter("lang = 'en'").select("id", F.col("content_text").alias("text"))
    return phrases.annotate(texts, L.lexicon(spark, d), L.phrases(spark, d))


@query("src6_main_text", """with a as (select page_id, html, regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1) as own from pages), b as (select page_id, regexp_replace(regexp_replace(own, '<(br|/?p|/?h1|/?li|/?ul|/?div)[^>]*>', ' ', 'gi'), '<[^>]+>', '', 'g') as own from a),
 c as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(own, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) as main_text from b) select page_id, main_text, len(string_split(main_text, ' ')) as main_words, len(string_split(main_text, ' ')) >= 400 as enough, null::varchar as defect from c""")
def src6_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Every page's main text, found by its shape, not by its element's name."""
    found = extraction.extract(L.table(spark, d, "pages").select("page_id", "html"))
    return found.select("page_id", T.collapse_spaces(F.col("main_text")).alias("main_text"), "main_words", (F.col("main_words") >= extraction.LEAST_WORDS).alias("enough"), "defect")



@query("t34_clip", "select id, trim(left(title, 60)) as clipped from articles", ("articles",))
def t34_clip(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", T.clip(F.col("title"), 60).alias("clipped"))


@query("t35_strip_fences", "select event_id, json_extract_string(props, '$.k') as k, props is not null as has from events")
def t35_strip_fences(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return L.table(spark, d, "events").select("event_id", F.get_json_object(T.strip_fences(fenced), "$.k").alias("k"), F.col("props").isNotNull().alias("has"))


@query("t37_context", None)
def t37_context(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).filter("lang = 'en'").select("id", T.context_around(F.col("content_text"), F.lit("the")).alias("context"))


@query("t38_markdown", "select id, len(regexp_extract_all(content_text, '(?m)^#{{1,6}}\\s+\\S')) >= 2 or regexp_matches(content_text, '(?m)^\\s*\\d+\\.\\s+\\S') and regexp_matches(content_text, '(?m)^>\\s+\\S') as markdown from articles".replace("{{", "{").replace("}}", "}"), ("articles",))
def t38_markdown(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", T.looks_like_markdown(F.col("url"), F.regexp_replace("content_text", r"(?m)^\s*[-*+]\s+|\*\*|\]\(|```", "")).alias("markdown"))


@query("t42_formats", "select id, case when dwell_ms // 60000 < 60 then (dwell_ms // 60000) || ' 分钟' when dwell_ms // 60000 % 60 = 0 then (dwell_ms // 3600000) || ' 小时' else (dwell_ms // 3600000) || ' 小时 ' || (dwell_ms // 60000 % 60) || ' 分' end as minutes from articles", ("articles",))
def t42_formats(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d).select("id", T.format_minutes(F.expr("dwell_ms div 60000")).alias("minutes"))


@query("t43_blocked_hosts", """with h as (select event_id, (event_id % 256) || '.' || (user_id * 7 % 256) || '.0.1' as host, event_id % 256 as a, user_id * 7 % 256 as b from events) select host, bool_or(a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 198 and b in (18, 19))) as blocked from h group by host""")
def t43_blocked_hosts(spark: SparkSession, d: str) -> DataFrame:
    hosts = L.table(spark, d, "events").select(F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") * 7 % 256).cast("string"), F.lit("0"), F.lit("1")).alias("host")).distinct()
    return hosts.select("host", T.blocked_host(F.col("host")).alias("blocked"))


@query("t44_part_of_speech", "select id, case word_type when 'n/v' then 'n · v' else word_type end as label from memory", ("memory",))
def t44_part_of_speech(spark: SparkSession, d: str) -> DataFrame:
    return L.memory(spark, d).select("id", T.part_of_speech(F.col("word_type")).alias("label"))


@query("n12_retry", "select user_id, (600 * power(2, least(count(*), 4)))::int as seconds from events where event_type = 'error' group by user_id")
def n12_retry(spark: SparkSession, d: str) -> DataFrame:
    """How long to wait behind each user's failures so far."""
    failed = L.table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return failed.select("user_id", scoring.retry_seconds(F.col("n")).cast("int").alias("seconds"))


@query("t36_chat_url", "select distinct source, case source when 'src1' then 'https://api.openai.com/v1/chat/completions' when 'src2' then 'https://h/v1/chat/completions' else 'https://h/' || source || '/chat/completions' end as url from documents")
def t36_chat_url(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    base = F.when(s == "src1", "https://api.openai.com/").when(s == "src2", " https://h/v1/chat/completions/ ").otherwise(F.concat(F.lit("https://h/"), s, F.lit("//")))
    return L.table(spark, d, "documents").select("source").distinct().select("source", T.chat_url(base).alias("url"))


@query("t39_selections", "with t as (select doc_id, array_to_string(list_slice(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, (doc_id % 8)::int + 1), ' ') as t from documents) select doc_id, regexp_matches(t, '^[A-Za-z][A-Za-z''’-]*( [A-Za-z][A-Za-z''’-]*){1,5}$') as phrase, length(t) >= 2 and regexp_matches(t, '^[A-Z][A-Z0-9.\\-&/]*$') as caps from t")
def t39_selections(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    t = L.table(spark, d, "documents").select("doc_id", F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 8).cast("int") + 1), " ").alias("t"))
    return t.select("doc_id", T.is_phrase_selection(F.col("t")).alias("phrase"), T.is_all_caps(F.col("t")).alias("caps"))


@query("t40_stable_json", "select doc_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' as key from documents")
def t40_stable_json(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return L.table(spark, d, "documents").select("doc_id", T.stable_json(pairs).alias("key"))


@query("t41_insight", "select '今日 0 · 本周 ' || count(*) filter (last_opened_at >= timestamp '2024-01-24 00:00:00') || ' · 总 ' || count(last_opened_at) || ' · 本周新词 3' as line from articles", ("articles",))
def t41_insight(spark: SparkSession, d: str) -> DataFrame:
    one = stats.learning_stats(L.articles(spark, d), L.memory(spark, d), L.now_column())
    return one.select(T.insight(F.col("opened_today"), F.col("opened_7d"), F.col("opened_total"), F.lit(3)).alias("line"))


# --- dictionary, exports ---------------------------------------------------------------------------------------------


@query("j9_sentence_links", """with e as (select doc_id as id, split_part(text, chr(10), 1) as s from documents where lang = 'en'), o as (select doc_id as id, split_part(text, chr(10), 1) as t from documents where lang = 'fr'), l as (select e.doc_id as a, o.doc_id as b from documents e join documents o on o.doc_id = e.doc_id + 1) select e.id as doc_id, e.s as sentence, o.t as translation from l join e on e.id = l.a join o on o.id = l.b""")
def j9_sentence_links(spark: SparkSession, d: str) -> DataFrame:
    docs = L.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.substring_index("text", "\n", 1).alias("text"))
    links = docs.select(F.col("id").alias("eng_id"), (F.col("id") + 1).alias("other_id"))
    return etl.linked_sentences(links, docs.filter("lang = 'en'"), docs.filter("lang = 'fr'"))


@query("j11_dictionary", None)
def j11_dictionary(spark: SparkSession, d: str) -> DataFrame:
    lex = L.lexicon(spark, d)
    sentences = L.table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.explode(F.filter(F.split("text", r"\. "), lambda s: F.char_length(s).between(20, 200))).alias("sentence"))
    details = lex.filter("rank % 3 = 0").select(F.col("term").alias("word"), F.concat(F.lit("gloss of "), F.col("term")).alias("gloss"))
    heads = lex.select(F.col("term").alias("word"), "rank")
    return etl.dictionary(heads, details, etl.examples(sentences, heads), 1500)


@query("snk5_memory_export", "select kind, term, definition, word_type, case when collocations_json like '[\"%' then replace(substr(collocations_json, 3, length(collocations_json) - 4), '\",\"', '; ') else '' end as collocations, case when context_sentence like '=%' then '''' || context_sentence else context_sentence end as context_sentence, article_id, status, created_at::varchar as created_at from memory", ("memory",))
def snk5_memory_export(spark: SparkSession, d: str) -> DataFrame:
    return writers.memory_rows(L.memory(spark, d))


@query("w10_newest_snapshots", "select o_orderkey as path, o_orderdate as at from orders order by o_orderdate desc, o_orderkey desc limit 2")
def w10_newest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return writers.newest(L.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("at")))


@query("u1_batched_cards")
def u1_batched_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards by a stand-in for an outside model that fails on some inputs and on large batches."""

    def model(items):
        if len(items) > 4 or any(len(x) % 7 == 0 for x in items):
            raise ValueError("overloaded")
        return [x.upper() for x in items]

    return enrich.enriched(L.articles(spark, d, reading=False).filter("summary = ''").select("id", "title"), "title", model, "card")


# --- streams ---------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, for what a stream writes."""
    return f"{dedup.shared_root(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, d: str, table: str) -> DataFrame:
    schema = L.table(spark, d, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/{table}.parquet*")


def _memory_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream to its end and gives its result; for aggregates, whose result is small."""
    name = f"s{uuid.uuid4().hex}"
    done = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", _folder(stream.sparkSession)).start()
    done.awaitTermination()
    return stream.sparkSession.table(name)


@query("st1_stream_ingest", "select doc_id, 'https://example.com/' || source || '/' || doc_id as url, split_part(text, chr(10), 1) as title from documents")
def st1_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    docs = _streamed(spark, d, "documents")
    entries = docs.select("doc_id", F.concat(F.lit("HTTPS://Example.com/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x#top")).alias("url"), F.substring_index("text", "\n", 1).alias("title"))
    folder = _folder(spark)
    for run in ("a", "b"):  # the second run, with state of its own, finds nothing new
        ingest.ingest(entries, f"{folder}/table", f"{folder}/{run}").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("doc_id", "url", "title")


@query("st2_stream_dedup", "select count(distinct array_to_string(list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ')) as n from documents")
def st2_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = _streamed(spark, d, "documents")
    entries = docs.select(F.lit("https://example.com/x").alias("url"), F.substring_index("text", "\n", 1).alias("title"), (F.lit(L.NOW).cast("timestamp") - F.make_dt_interval(hours=(F.col("doc_id") % 300).cast("int"))).alias("published"))
    folder = _folder(spark)
    run = ingest.deduplicated(entries).select("title_key").writeStream.format("parquet").option("path", f"{folder}/t").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/t").agg(F.count(F.lit(1)).alias("n"))


@query("st5_dwell_stream", "select user_id as article_id, sum(least(greatest(floor(value * 1000)::bigint, 0), 60000))::bigint as dwell_ms, bool_or(event_type = 'purchase' or (event_type = 'signup' and floor(value * 1000) >= 15000)) as completed from events group by user_id")
def st5_dwell_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _streamed(spark, d, "events")
    beats = e.select(F.col("user_id").alias("article_id"), F.floor(F.col("value") * 1000).cast("long").alias("delta_ms"), (F.col("event_type") == "purchase").alias("bottom"), (F.col("event_type") == "signup").alias("short"))
    return _memory_table(ingest.reading_time(beats), "complete")


@query("st9_feed_clock", "select event_type as feed, max(ts) filter (event_id % 3 = 0)::timestamp as last_new_article_at, avg((value > 50)::int)::double as fulltext_ratio from events group by event_type")
def st9_feed_clock(spark: SparkSession, d: str) -> DataFrame:
    e = _streamed(spark, d, "events")
    entries = e.select(F.col("event_type").alias("feed"), F.col("ts").alias("published"), (F.col("event_id") % 3 == 0).alias("is_new"), (F.col("value") > 50).alias("full_text"))
    return _memory_table(ingest.feed_clocks(entries), "complete")


@query("st_windowed_activity", "select date_trunc('day', ts)::date::varchar as day, event_type, count(*) as n from events group by all")
def st_windowed_activity(spark: SparkSession, d: str) -> DataFrame:
    e = _streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _memory_table(ingest.windowed_activity(e), "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
