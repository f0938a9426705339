"""Lists, lookups, search and joins over the library, each with SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog, gates
from ..functions import text as T
from ..operators import dedup, enrich, lexical, listing, merge, ranking, stats
from . import library as L
from .registry import query

NOW_SQL = "timestamp '2024-01-31 00:00:00'"
NEWEST_SQL = "fetched_at desc nulls last, published_at desc nulls last, coalesce(chapter_no, 0), id"
ITEM = ("id", "title", "source", "category", "word_count", "open_count", "liked", "read_completed")
ITEM_SQL = ", ".join(ITEM)

# --- lists, lookups, search ------------------------------------------------------------------------------------------


def _listed(name: str, sql_where: str, limit: int = 60, offset: int = 0, **conditions) -> None:
    @query(name, f"select {ITEM_SQL} from articles where {sql_where} order by {NEWEST_SQL} limit {limit} offset {offset}", ("articles",))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return listing.page(listing.select_articles(L.articles(spark, d), **conditions), limit, offset).select(*ITEM)


_listed("p2_library_page", "true")
_listed("p2_library_offset", "true", limit=25, offset=40)
_listed("p2_by_source", "source = 'src3'", source="src3")
_listed("p2_by_category", "category = 'tech'", category="tech")
_listed("p2_liked_only", "liked", liked_only=True)
_listed("p3_unread", "not read_completed and last_opened_at is null", state="unread")
_listed("p3_reading", "last_opened_at is not null and not read_completed", state="reading")
_listed("p3_unfinished", "not read_completed", state="unfinished")
_listed("p3_read", "read_completed", state="read")
_listed("p4_search", "contains(lower(title), 'tion') or contains(lower(summary), 'tion') or contains(lower(source), 'tion')", search=" TION ")
_listed("p4_search_literal", "contains(lower(title), '1_') or contains(lower(summary), '1_') or contains(lower(source), '1_')", search="1_")
_listed("p2_combined", "category = 'world' and source = 'src1' and not read_completed and contains(lower(summary), 'summary')", category="world", source="src1", state="unfinished", search="summary")


@query("p1_excerpt", "select id, substr(content_text, 1, 6000) as excerpt, length(content_text) as chars from articles", ("articles",))
def p1_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", T.excerpt(F.col("content_text")).alias("excerpt"), F.char_length("content_text").cast("long").alias("chars"))


@query("p5_article", "select id, url, title, source, category, word_count, dwell_ms from articles where id = '7' limit 1", ("articles",))
def p5_article(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d).filter("id = '7'").limit(1).select("id", "url", "title", "source", "category", "word_count", "dwell_ms")


@query("p6_term_lookup", "select id, kind, term, created_at from memory where lower(term) = (select lower(term) from memory where id = 'm60') order by created_at limit 1", ("memory",))
def p6_term_lookup(spark: SparkSession, d: str) -> DataFrame:
    memory = L.memory(spark, d)
    wanted = memory.filter("id = 'm60'").select(F.lower(F.trim("term")).alias("wanted"))
    return memory.join(F.broadcast(wanted), F.lower("term") == F.col("wanted"), "left_semi").orderBy("created_at").limit(1).select("id", "kind", "term", "created_at")


@query("p7_memory_list", "select id, term, word_type, created_at from memory where kind = 'word' and status = 'learning'", ("memory",))
def p7_memory_list(spark: SparkSession, d: str) -> DataFrame:
    return L.memory(spark, d).filter("kind = 'word' and status = 'learning'").orderBy(F.desc("created_at")).select("id", "term", "word_type", "created_at")


@query("p8_memory_filter", "select id, term, definition from memory where contains(lower(term), 'in') or contains(lower(word_type), 'in') or contains(definition, 'in')", ("memory",))
def p8_memory_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.memory(spark, d).filter(T.contains_folded(F.col("term"), "in") | T.contains_folded(F.col("word_type"), "in") | F.col("definition").contains("in")).select("id", "term", "definition")


@query("p9_url_lengths", "select url, length(content_text) as chars from articles", ("articles",))
def p9_url_lengths(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("url", F.char_length("content_text").cast("long").alias("chars"))


@query("p9_recent_titles", f"select id, title from articles where coalesce(published_at, fetched_at) >= {NOW_SQL} - to_days(14)", ("articles",))
def p9_recent_titles(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).filter(F.coalesce("published_at", "fetched_at") >= L.now_column() - F.make_dt_interval(days=F.lit(14))).select("id", "title")


@query("p10_rss_articles", "select id, source, word_count from articles where origin = 'rss'", ("articles",))
def p10_rss_articles(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).filter("origin = 'rss'").select("id", "source", "word_count")


@query("p11_backfill_queue", "select id, title, fetched_at from articles where trim(summary) = '' and origin <> 'book' order by fetched_at desc, id limit 200", ("articles",))
def p11_backfill_queue(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).filter((F.trim("summary") == "") & (F.col("origin") != "book")).orderBy(F.desc("fetched_at"), "id").limit(200).select("id", "title", "fetched_at")


@query("p12_engaged_titles", "select title, case when liked then 2.0 else 1.0 end::double as weight from articles where liked or read_completed", ("articles",))
def p12_engaged_titles(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d).filter("liked or read_completed").select("title", F.when(F.col("liked"), 2.0).otherwise(1.0).alias("weight"))


@query("p13_enabled_feeds", "select id, name, priority from feeds where enabled and kind <> 'book'", ("feeds",))
def p13_enabled_feeds(spark: SparkSession, d: str) -> DataFrame:
    return L.feeds(spark, d).filter("enabled and kind <> 'book'").select("id", "name", "priority")


_RAW_BOOKS = """raw as (select p_partkey::varchar || case when p_partkey % 13 = 0 then 'x' else '' end as gid, case when p_partkey % 9 = 0 then 'Sound' else 'Text' end as kind, case when p_partkey % 4 = 0 then 'de; en' when p_partkey % 7 = 0 then 'fr' else 'en' end as language,
 case when p_partkey % 31 = 0 then '  ' else p_name end as title, case p_partkey % 4 when 0 then p_brand || ', Jane, 1801-1880' when 1 then p_brand || ', Jane; Other, Ann' when 2 then 'Anonymous' else p_brand || ', A, B' end as authors, (1800 + p_size)::varchar || '-01-01' as issued,
 case p_partkey % 3 when 0 then 'Best Books; Category: ' || p_type when 1 then '; ' || p_type || '; x' else '' end as bookshelves from part)"""


def _raw_books(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return L.table(spark, d, "part").select(
        F.concat(k.cast("string"), F.when(k % 13 == 0, "x").otherwise("")).alias("gid"), F.when(k % 9 == 0, "Sound").otherwise("Text").alias("kind"), F.when(k % 4 == 0, "de; en").when(k % 7 == 0, "fr").otherwise("en").alias("language"),
        F.when(k % 31 == 0, "  ").otherwise(F.col("p_name")).alias("title"),
        F.when(k % 4 == 0, F.concat("p_brand", F.lit(", Jane, 1801-1880"))).when(k % 4 == 1, F.concat("p_brand", F.lit(", Jane; Other, Ann"))).when(k % 4 == 2, "Anonymous").otherwise(F.concat("p_brand", F.lit(", A, B"))).alias("authors"),
        F.concat((1800 + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("issued"), F.when(k % 3 == 0, F.concat(F.lit("Best Books; Category: "), "p_type")).when(k % 3 == 1, F.concat(F.lit("; "), "p_type", F.lit("; x"))).otherwise("").alias("bookshelves"),
    )


def books(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's accepted rows: gid, title, authors, issued, shelf."""
    raw = _raw_books(spark, d).filter(catalog.accepted(F.col("gid"), F.col("kind"), F.col("language"), F.col("title")))
    return raw.select(F.col("gid").cast("long").alias("gid"), T.collapse_spaces(F.col("title")).alias("title"), T.collapse_spaces(F.col("authors")).alias("authors"), "issued", catalog.shelf(F.col("bookshelves")).alias("shelf"))


_BOOKS_SQL = "with " + _RAW_BOOKS + """, books as (select gid::bigint as gid, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title, trim(regexp_replace(authors, '\\s+', ' ', 'g')) as authors, issued,
 case when contains(bookshelves, 'Category: ') then split_part(bookshelves, 'Category: ', 2) when bookshelves <> '' then trim(split_part(bookshelves, ';', 2)) else '' end as shelf
 from raw where try_cast(gid as bigint) is not null and kind = 'Text' and language in ('en', 'de; en') and trim(title) <> '') """


@query("p14_catalog_accept", _BOOKS_SQL + "select * from books")
def p14_catalog_accept(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d)


@query("p15_shelf_counts", _BOOKS_SQL + "select shelf, count(*) as n from books group by shelf")
def p15_shelf_counts(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).groupBy("shelf").agg(F.count(F.lit(1)).alias("n"))


@query("p16_author_description", _BOOKS_SQL + """select gid, author, case when author = '' then left(issued, 4) else author || ' · ' || left(issued, 4) end as description from (select *, case gid % 4 when 2 then authors when 3 then authors else 'Jane ' || split_part(split_part(authors, ';', 1), ',', 1) end as author from books)""")
def p16_author_description(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("gid", catalog.display_author(F.col("authors")).alias("author"), catalog.description(catalog.display_author(F.col("authors")), F.col("issued")).alias("description"))


@query("p18_gid_from_url", "select url, try_cast(regexp_extract(url, '/([0-9]+)/?$', 1) as bigint) as gid from pages")
def p18_gid_from_url(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("url", catalog.gid_of(F.col("url")).alias("gid"))


@query("p19_length_band", "select case when word_count <= 0 then '' when word_count < 600 then '很短' when word_count < 900 then '短' when word_count < 1200 then '中' when word_count < 1800 then '长' when word_count < 3000 then '很长' else '极长' end as band, count(*) as n from articles group by band", ("articles",))
def p19_length_band(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).groupBy(catalog.length_band(F.col("word_count")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("p20_needs_summary", "select id, trim(summary) as blurb, trim(summary) = '' as needs from articles", ("articles",))
def p20_needs_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(spark, d, reading=False).select("id", F.trim("summary").alias("blurb"), (F.trim("summary") == "").alias("needs"))


NEEDS_SQL = "(definition = '' or word_type = '' or (kind = 'phrase' and word_type = 'phrase'))"


@query("p21_needs_enrichment", f"select id, kind, {NEEDS_SQL} as needs from memory", ("memory",))
def p21_needs_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return L.memory(spark, d).select("id", "kind", enrich.needs_fields(F.col("kind"), F.col("definition"), F.col("word_type")).alias("needs"))


#: Function words that the placement test doesn't ask for.
PLACEMENT_STOP = "a an the of to and or in on at is are be am was were been i you he she it we they my your his her its our their this that these those as by for with from not no yes do does did have has had".split()
POOL_SQL = f"select term, rank from lexicon where length(term) >= 2 and not contains(term, ' ') and term not in ({', '.join(repr(w) for w in PLACEMENT_STOP)})"


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Words of the placement test, with glosses that repeat now and then."""
    words = L.lexicon(spark, d).filter((F.char_length("term") >= 2) & ~F.col("term").contains(" ") & ~F.col("term").isin(*PLACEMENT_STOP))
    return words.select("term", "rank", F.concat(F.lit("gloss "), (F.col("rank") % 997).cast("string")).alias("gloss"))


@query("p22_placement_pool", POOL_SQL, ("lexicon",))
def p22_placement_pool(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("term", "rank")


_LABELS = [("world", "World"), ("tech", "Technology"), ("finance", "Finance")]


@query("p23_category_label", "with labels_of as (select * from (values ('world', 'World'), ('tech', 'Technology'), ('finance', 'Finance')) v(category, label)) select distinct a.category, coalesce(label, a.category) as label from (select case lang when 'en' then 'world' when 'fr' then 'tech' when 'de' then 'finance' else 'other' end as category from documents) a left join labels_of using (category)")
def p23_category_label(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame(_LABELS, "category string, label string")
    return L.articles(spark, d, reading=False).select("category").distinct().join(F.broadcast(labels), "category", "left").select("category", F.coalesce("label", "category").alias("label"))


@query("p25_feed_order", "select id, category, priority, row_number() over (order by category, priority desc, name) as place from feeds", ("feeds",))
def p25_feed_order(spark: SparkSession, d: str) -> DataFrame:
    return L.feeds(spark, d).withColumn("place", F.row_number().over(Window.orderBy("category", F.desc("priority"), "name"))).select("id", "category", "priority", "place")


@query("p26_catalog_count", _BOOKS_SQL + "select count(*) as n, max(issued) as stamp from books")
def p26_catalog_count(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max("issued").alias("stamp"))


def _search(name: str, text: str, shelf: str = "") -> None:
    where = f"(contains(lower(title), '{text}') or contains(lower(authors), '{text}'))" + (f" and shelf = '{shelf}'" if shelf else "")
    order = f"case when starts_with(lower(title), '{text}') then 0 when contains(lower(title), '{text}') then 1 else 2 end"

    @query(name, _BOOKS_SQL + f"select gid, title, {order}::int as relevance from books where {where} order by relevance, length(title), title, gid limit 40")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return listing.search_catalog(books(spark, d), text.upper(), 40, shelf).select("gid", "title", "relevance")


_search("s2_catalog_search", "1")
_search("s2_catalog_search_shelf", "e", "STANDARD")
_search("s2_catalog_search_author", "jane")

# --- joins -----------------------------------------------------------------------------------------------------------


@query("j1_imported_flag", _BOOKS_SQL + ", imported as (select distinct number as gid from (select doc_id as number from documents where doc_id % 11 = 0)) select b.gid, i.gid is not null as imported from books b left join imported i using (gid)")
def j1_imported_flag(spark: SparkSession, d: str) -> DataFrame:
    imported = L.articles(spark, d, reading=False).filter("origin = 'book'").select(F.col("number").alias("there")).distinct()
    return books(spark, d).join(imported, F.col("gid") == F.col("there"), "left").select("gid", F.col("there").isNotNull().alias("imported"))


@query("j2_feed_counts", "select f.id, coalesce(n, 0) as n from feeds f left join (select source, count(*) as n from articles group by source) c on f.name = c.source", ("feeds",))
def j2_feed_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.feeds(spark, d).join(stats.counts_by_source(L.articles(spark, d, reading=False)), F.col("name") == F.col("source"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("j3_affinity", """select a.id, coalesce(so, 0)::bigint as source_opens, coalesce(co, 0)::bigint as category_opens, coalesce(f.priority, 0) as source_priority, coalesce(cp, 0) as category_priority from articles a left join (select source, sum(open_count) as so from articles group by source) s on a.source = s.source
 left join (select category, sum(open_count) as co from articles group by category) c on a.category = c.category left join feeds f on f.name = a.source left join (select category, max(priority) as cp from feeds group by category) m on m.category = a.category""", ("feeds",))
def j3_affinity(spark: SparkSession, d: str) -> DataFrame:
    a = L.articles(spark, d)
    return ranking.with_affinity(a, a, L.feeds(spark, d)).select("id", "source_opens", "category_opens", "source_priority", "category_priority")


_CANON_SQL = """case when regexp_matches(url, '^(?i)https?://[^/?#]+') then lower(regexp_extract(url, '^(?i)(https?://[^/?#]+)', 1)) || case when regexp_replace(regexp_extract(url, '^(?i)https?://[^/?#]+([^?#]*)', 1), '/+$', '') = '' then '/' else regexp_replace(regexp_extract(url, '^(?i)https?://[^/?#]+([^?#]*)', 1), '/+$', '') end
 || case when len(kept) > 0 then '?' || list_aggregate(kept, 'string_agg', '&') else '' end else url end"""
_CANON_FROM = f"""(select *, list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and split_part(p, '=', 1) not in ({', '.join(repr(p) for p in T.TRACKING_PARAMS)})), lambda p: case when contains(p, '=') then p else p || '=' end) as kept from pages)"""


@query("d1_canonical_url", f"select page_id, {_CANON_SQL} as canonical from {_CANON_FROM}")
def d1_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("j4_new_urls", f"with c as (select page_id, {_CANON_SQL} as canonical from {_CANON_FROM}) select canonical, min(page_id) as page_id from c where page_id % 3 <> 0 and canonical not in (select canonical from c where page_id % 3 = 0) group by canonical")
def j4_new_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = d1_canonical_url(spark, d)
    known, new = pages.filter("page_id % 3 = 0"), pages.filter("page_id % 3 <> 0")
    return new.join(known, "canonical", "left_anti").groupBy("canonical").agg(F.min("page_id").alias("page_id"))


@query("j5_upgrades", """with new as (select url, number, content_text || ' more' as t, number % 4 as r from articles), ok as (select n.url, n.t from new n join articles a using (url) where a.origin = 'rss' and length(n.t) >= 2000 and a.word_count + 1 >= 400 and length(n.t) > length(a.content_text)) select url, length(t) as chars from ok""", ("articles",))
def j5_upgrades(spark: SparkSession, d: str) -> DataFrame:
    stored = L.articles(spark, d, reading=False)
    new = stored.select("url", "number", F.concat("content_text", F.lit(" more")).alias("content_text"))
    return merge.upgrades(stored, new, F.lit(gates.TRUST_CHARS)).select("url", F.char_length("content_text").cast("long").alias("chars"))


@query("j6_exact_titles", "with t as (select number, array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') as k from articles) select number from (select *, row_number() over (partition by k order by number) as r from t) where r = 1 or k = ''", ("articles",))
def j6_exact_titles(spark: SparkSession, d: str) -> DataFrame:
    keyed = L.articles(spark, d, reading=False).select("number", F.array_join(T.title_tokens(F.col("title")), " ").alias("k"))
    return keyed.filter("k <> ''").groupBy("k").agg(F.min("number").alias("number")).select("number").unionByName(keyed.filter("k = ''").select("number"))


_TOKENS_SQL = "t as (select number, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda x: x <> ''))) as s, len(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda x: x <> '')) as n from articles), nodes as (select s, min(number) as node from t where n >= 8 group by s)"


@query("j7_jaccard_pairs", f"with {_TOKENS_SQL} select a.node as a, b.node as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) as similarity from nodes a join nodes b on a.node < b.node and len(list_intersect(a.s, b.s)) >= 0.85 * len(list_distinct(list_concat(a.s, b.s)))", ("articles",))
def j7_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    titles = L.articles(spark, d, reading=False).select(F.col("number").alias("id"), T.title_tokens(F.col("title")).alias("tokens"))
    return dedup.similar_pairs(titles).withColumn("similarity", F.round("similarity", 6))


_GREEDY_SQL = f"""with recursive {{articles}}, {_TOKENS_SQL}, raw as (select number, list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda x: x <> '') as tk from articles),
 links as (select a.node as a, b.node as b from nodes a join nodes b on a.node < b.node and len(list_intersect(a.s, b.s)) >= 0.85 * len(list_distinct(list_concat(a.s, b.s)))), ids as (select distinct unnest([a, b]) as o from links),
 walk as (select min(o) as o, [min(o)] as kept from ids having min(o) is not null union all select min(i.o), list_append(any_value(w.kept), min(i.o)) from walk w join ids i on i.o > w.o left join links l on l.b = i.o and list_contains(w.kept, l.a) where l.a is null having min(i.o) is not null)
 select node as number from nodes where node not in (select o from ids) or node in (select o from walk) union all select min(number) from raw where len(tk) between 1 and 7 group by tk union all select number from raw where len(tk) = 0"""


@query("d2_greedy_kept", _GREEDY_SQL.replace("{articles}", L.with_views("articles", sql="")[5:]))
def d2_greedy_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.greedy_kept(L.articles(spark, d, reading=False).select("number", "title"), key="number")


_CHAPTERS_SQL = "b as (select id, source, chapter_no from articles where origin = 'book')"


@query("j8_chapter_neighbours", f"with {_CHAPTERS_SQL} select id, source, chapter_no, lag(id) over w as previous, lead(id) over w as next, count(*) over (partition by source) as chapters from b window w as (partition by source order by chapter_no)", ("articles",))
def j8_chapter_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return stats.neighbours(L.articles(spark, d, reading=False).filter("origin = 'book'"))


def lemma_forms_sql(word: str) -> str:
    """The base forms of a word that aren't the word, likeliest first, as a SQL list."""
    ways = []
    for ending, least, made in lexical._ENDINGS:
        cut, quoted = f"left({word}, length({word}) - {len(ending)})", ending.replace("'", "''")
        fits = f"ends_with({word}, '{quoted}') and length({word}) >= {len(ending) + max(least, 1)}"
        if ending == "s":
            fits += f" and not regexp_matches({word}, '(s|u|i)s$')"
        for way in made:
            ways.append(f"case when {fits} and length({cut}) >= 2 and left(right({cut}, 2), 1) = right({cut}, 1) then left({cut}, length({cut}) - 1) end" if way == "2" else f"case when {fits} then {cut} || '{way}' end")
    return f"case when length({word}) >= 3 and not contains({word}, ' ') then list_filter([{', '.join(ways)}], lambda f: f is not null and f <> {word} and length(f) >= 2) else [] end"


def lookup_sql(terms: str, entries: str) -> str:
    """Common table expressions `tried` (term, place, form; the term itself at 0) and `hits` (term, entry, rank)."""
    return f"""asked as (select distinct term from ({terms})), formed as (select term, list_concat([term], {lemma_forms_sql("term")}) as forms from asked),
 tried as (select term, unnest(forms) as form, generate_subscripts(forms, 1) - 1 as place from formed),
 hits as (select t.term, arg_min(e.term, place) as entry, arg_min(e.rank, place) as rank from tried t join ({entries}) e on e.term = t.form group by t.term)"""


_TITLES_SQL = "select unnest(list_filter(regexp_extract_all(lower(title), '[a-z][a-z''-]*'), lambda t: length(t) >= 2)) as term from articles where lang = 'en'"


@query("j12_lookup_fallback", f"with {lookup_sql(_TITLES_SQL, 'select term, rank from lexicon')} select a.term, entry, rank from asked a left join hits using (term)", ("articles", "lexicon"))
def j12_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    words = L.articles(spark, d, reading=False).filter("lang = 'en'").select(F.explode(F.array_distinct(T.difficulty_tokens(F.col("title")))).alias("term"))
    return lexical.looked_up(words, L.lexicon(spark, d))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """article_id, idx, text of the lines of all articles."""
    return L.articles(spark, d, reading=False).select(F.col("id").alias("article_id"), F.posexplode(F.split("content_text", "\n")).alias("idx", "text"))


def translations(spark: SparkSession, d: str) -> DataFrame:
    """Cached translations of even paragraphs; every third was made from another text."""
    p = paragraphs(spark, d).filter("idx % 2 = 0")
    return p.select("article_id", F.lit("paragraph").alias("scope"), F.col("idx").cast("string").alias("scope_key"), F.when(F.col("idx") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("source_text"), F.concat(F.lit("translated "), F.col("idx").cast("string")).alias("translated_text"))


_PARA_SQL = """para as (select id as article_id, unnest(string_split(content_text, chr(10))) as text, generate_subscripts(string_split(content_text, chr(10)), 1) - 1 as idx from articles),
 tr as (select article_id, idx::varchar as scope_key, case when idx % 6 = 0 then text || '!' else text end as source_text, 'translated ' || idx as translated_text from para where idx % 2 = 0)"""


@query("j15_cache_valid", f"with {_PARA_SQL} select p.article_id, p.idx, t.translated_text is not null as valid, t.translated_text from para p left join tr t on p.article_id = t.article_id and p.idx::varchar = t.scope_key and p.text = t.source_text", ("articles",))
def j15_cache_valid(spark: SparkSession, d: str) -> DataFrame:
    return merge.valid_translations(paragraphs(spark, d), translations(spark, d))


@query("p24_translation_map", f"with {_PARA_SQL} select article_id, count(*) as n, min(translated_text) as least from tr group by article_id", ("articles",))
def p24_translation_map(spark: SparkSession, d: str) -> DataFrame:
    maps = translations(spark, d).filter("scope = 'paragraph'").groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("scope_key", "translated_text"))).alias("m"))
    return maps.select("article_id", F.size("m").cast("long").alias("n"), F.array_min(F.map_values("m")).alias("least"))


@query("j14_article_view", f"with {_PARA_SQL} select p.article_id, count(*) as paragraphs, count(t.translated_text) as translated, a.title, a.chapter_no from para p join articles a on a.id = p.article_id left join tr t on p.article_id = t.article_id and p.idx::varchar = t.scope_key and p.text = t.source_text group by all", ("articles",))
def j14_article_view(spark: SparkSession, d: str) -> DataFrame:
    nested = j15_cache_valid(spark, d).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("idx", "translated_text"))).alias("parts"))
    view = L.articles(spark, d, reading=False).join(nested, F.col("id") == F.col("article_id"))
    return view.select("article_id", F.size("parts").cast("long").alias("paragraphs"), F.size(F.filter("parts", lambda p: p["translated_text"].isNotNull())).cast("long").alias("translated"), "title", "chapter_no")


@query("j16_cascade", "with gone as (select id from articles where number % 5 = 0) select (select count(*) from memory where article_id in (select id from articles where number % 5 <> 0)) as cascaded, (select count(*) from memory where article_id is null or article_id not in (select id from articles where number % 5 <> 0)) as nulled", ("articles", "memory"))
def j16_cascade(spark: SparkSession, d: str) -> DataFrame:
    left, children = L.articles(spark, d, reading=False).filter("number % 5 <> 0"), L.memory(spark, d)
    cascaded = merge.cascaded(children, left, "article_id").agg(F.count(F.lit(1)).alias("cascaded"))
    return cascaded.crossJoin(merge.nulled(children, left, "article_id").agg(F.count_if(F.col("article_id").isNull()).alias("nulled")))


@query("j17_lookup_cascade", "select m.id, coalesce(l.term, m.term) as shown, case when l.term is not null then 'local' else 'ai' end as origin from memory m left join lexicon l on l.term = m.term", ("memory",))
def j17_lookup_cascade(spark: SparkSession, d: str) -> DataFrame:
    entry = L.lexicon(spark, d).select(F.col("term").alias("entry"))
    return L.memory(spark, d).join(entry, F.col("term") == F.col("entry"), "left").select("id", F.coalesce("entry", "term").alias("shown"), F.when(F.col("entry").isNotNull(), "local").otherwise("ai").alias("origin"))


@query("j18_ordered_merge", "with w as (select id, case id when 'feed-src9' then 0 when 'feed-src2' then 1 end as place, row_number() over (order by id) as pos from feeds) select id, row_number() over (order by place nulls last, pos) as n from w", ("feeds",))
def j18_ordered_merge(spark: SparkSession, d: str) -> DataFrame:
    placed = L.feeds(spark, d).select("id").withColumn("pos", F.row_number().over(Window.orderBy("id")))
    wanted = spark.createDataFrame([("feed-src9", 0), ("feed-src2", 1)], "id string, place int")
    return placed.join(F.broadcast(wanted), "id", "left").select("id", F.row_number().over(Window.orderBy(F.asc_nulls_last("place"), "pos")).alias("n"))
