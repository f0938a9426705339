"""The reading library as views over raw tables: articles, feeds, lexicon, memory, catalog, entries.

Raw tables know nothing of reading, so activity comes from events (an event's user is the article it opens), likes from
labels, and times from ids, all by fixed rules that SQL states too (`SQL`). `NOW` is given, never asked from a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.phrases import WORD, folded

NOW = "2024-01-31 00:00:00"
RETENTION_DAYS = 14


def now_column():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, open_count, last_opened_at, dwell_ms, read_completed of opened articles, in one aggregation."""
    opened = F.col("event_type").isin("view", "click")
    latest = F.max_by("event_type", F.struct("ts", "event_id"))
    return (
        table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("article_id"))
        .agg(
            F.count_if(opened).alias("open_count"), F.max(F.when(opened, F.col("ts"))).alias("last_opened_at"),
            F.coalesce(F.sum(F.when(opened, F.floor(F.col("value") * 1000))), F.lit(0)).cast("long").alias("dwell_ms"), latest.isin("purchase", "signup").alias("read_completed"),
        )
    )


def articles(spark: SparkSession, sf_dir: str, reading: bool = True) -> DataFrame:
    """One row a document, with reading activity and likes unless `reading` is off: outer joins can't be pruned, so who needs neither says so."""
    doc = F.col("doc_id")
    hours = F.make_dt_interval(hours=((doc * 37) % 1200).cast("int"))
    days = F.make_dt_interval(days=F.floor(((doc * 37) % 1200) / 24).cast("int"))
    book = doc % 11 == 0
    base = table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("id"), doc.alias("number"), F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), doc.cast("string")).alias("url"),
        F.left(F.substring_index("text", "\n", 1), F.lit(160)).alias("title"), "source",
        F.when(F.col("lang") == "en", "world").when(F.col("lang") == "fr", "tech").when(F.col("lang") == "de", "finance").otherwise("other").alias("category"),
        F.col("text").alias("content_text"), "lang", (now_column() - hours).alias("published_at"), (now_column() - days).alias("fetched_at"),
        F.when(book, "book").otherwise("rss").alias("origin"), F.when(book, F.floor(doc / 11) + 1).alias("chapter_no"),
        F.when(doc % 3 == 0, F.concat(F.lit("summary "), doc.cast("string"))).otherwise("").alias("summary"), T.word_count(F.col("text")).alias("word_count"),
    )
    if not reading:
        return base
    liked = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("liked_id")).distinct()
    joined = base.join(activity(spark, sf_dir), F.col("number") == F.col("article_id"), "left").join(liked, F.col("number") == F.col("liked_id"), "left")
    return joined.select(
        *base.columns, F.coalesce("open_count", F.lit(0)).cast("long").alias("open_count"), "last_opened_at", F.coalesce("dwell_ms", F.lit(0)).cast("long").alias("dwell_ms"),
        F.coalesce("read_completed", F.lit(False)).alias("read_completed"), F.col("liked_id").isNotNull().alias("liked"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source: its most frequent category, a priority within it (of the first half of names), state and clock."""
    by = articles(spark, sf_dir, reading=False).groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("at"))
    feed = by.groupBy("source").agg(F.max_by("category", F.struct("n", "category")).alias("category"), F.max("at").alias("last_new_article_at"), F.sum("n").alias("n_articles"))
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return feed.select(
        F.concat(F.lit("feed-"), F.col("source")).alias("id"), F.col("source").alias("name"), "category", F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/rss")).alias("url"),
        (number % 5 != 4).alias("enabled"), F.when(number % 3 == 0, "user").otherwise("curated").alias("origin"), F.when(number % 7 == 6, "book").otherwise("rss").alias("kind"),
        F.when(number < 10, number % 4).otherwise(0).cast("long").alias("priority"), (number / 20.0 - F.when(number % 6 == 5, 2.0).otherwise(0.0)).alias("fulltext_ratio"),
        (F.col("last_new_article_at") - F.make_dt_interval(days=F.when(number % 8 == 7, 31).otherwise(0))).alias("last_new_article_at"), "n_articles",
    )


def counted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term and n of the English documents' words."""
    words = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(T.difficulty_tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, n and rank (by count, then alphabet) of the English documents' words; derived, as no word list comes with the data."""
    return ranked_words(counted_words(spark, sf_dir))


def first_words(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """term of the words that `lexicon` ranks up to `most`, which is few: a top-k, no ranks are made."""
    return counted_words(spark, sf_dir).orderBy(F.desc("n"), "term").limit(most).select("term")


def ranked_words(counted: DataFrame) -> DataFrame:
    """term, n and rank of all words, without sorting them in one task.

    Words of one count are ranked by themselves, rare ones in parts by their first letters; what stands before each part
    is summed over the parts, of which there are few: the different counts, and for counts up to 100 the beginnings.
    """
    parts = counted.withColumn("part", F.when(F.col("n") <= 100, F.left("term", F.lit(3))).otherwise(""))
    sizes = parts.groupBy("n", "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy(F.desc("n"), "part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("n", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("n", "part").orderBy("term"))
    return parts.withColumn("own", own).join(before, ["n", "part"]).select("term", "n", (F.col("before") + F.col("own")).cast("int").alias("rank"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key of the phrases that English titles begin with: two to five words, by the article's number."""
    words = F.regexp_extract_all("title", F.lit(f"({WORD})"), F.lit(1))
    begun = articles(spark, sf_dir, reading=False).filter("lang = 'en'").withColumns({"words": words, "n": (F.col("number") % 4 + 2).cast("int")}).filter(F.size("words") >= F.col("n"))
    return begun.select(F.array_join(F.transform(F.slice("words", F.lit(1), F.col("n")), folded), " ").alias("key")).distinct()



def entries(spark: SparkSession, sf_dir: str, reading: bool = False) -> DataFrame:
    """Articles as feed entries, with planted defects so that every gate has cases; with reading activity only if asked for."""
    n = F.col("number")
    body = F.when(n % 19 == 2, F.concat(F.lit("Skip to main content\n"), F.col("content_text"))).otherwise(F.col("content_text"))
    for rest, of, tail in ((1, 17, " Continue reading…"), (4, 29, " Subscription required."), (5, 31, " 12:34" * 20)):
        body = F.when(n % of == rest, F.concat(body, F.lit(tail))).otherwise(body)
    body = F.when(n % 37 == 6, F.concat(body, F.repeat(F.lit(" https://x.example"), F.floor(F.col("word_count") / 8).cast("int") + 1))).otherwise(body)
    title = F.when(n % 23 == 3, F.concat(F.lit("Weekly links: "), F.col("title"))).otherwise(F.col("title"))
    published = F.when(n % 41 == 7, now_column() - F.make_dt_interval(days=F.lit(40))).otherwise(F.col("published_at"))
    return articles(spark, sf_dir, reading).withColumns({"title": title, "content_text": body, "published_at": published})


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and phrases being learned: the most frequent words from rank 50, and pairs of them, with states by rank."""
    r = F.col("rank")
    few = lexicon(spark, sf_dir).filter(r.between(50, 249))
    term = F.when(r % 5 == 0, F.concat(F.col("term"), F.lit(" up"))).otherwise(F.col("term"))
    return few.select(
        F.concat(F.lit("m"), r.cast("string")).alias("id"), F.when(r % 5 == 0, "phrase").otherwise("word").alias("kind"), term.alias("term"),
        F.when(r % 4 == 0, "").otherwise(F.concat(F.lit("gloss of "), F.col("term"))).alias("definition"), F.when(r % 5 == 0, "phrase").when(r % 3 == 0, "").otherwise("n/v").alias("word_type"),
        F.when(r % 2 == 0, F.to_json(F.array(F.concat(F.col("term"), F.lit(" on")), F.lit("in use")))).when(r % 7 == 0, "broken").otherwise("[]").alias("collocations_json"),
        F.when(r % 6 == 0, "=sum").otherwise(F.concat(F.lit("see "), F.col("term"))).alias("context_sentence"), F.when(r % 3 == 0, "mastered").otherwise("learning").alias("status"),
        (r % 40).cast("string").alias("article_id"), (now_column() - F.make_dt_interval(hours=r)).alias("created_at"),
    )


#: The same views for DuckDB, as common table expressions by name.
SQL_VIEWS = {
    "activity": """select user_id as article_id, count(*) filter (event_type in ('view', 'click')) as open_count, max(ts) filter (event_type in ('view', 'click')) as last_opened_at,
        coalesce(sum(floor(value * 1000)) filter (event_type in ('view', 'click')), 0)::bigint as dwell_ms, arg_max(event_type, {'t': ts, 'e': event_id}) in ('purchase', 'signup') as read_completed from events group by user_id""",
    "articles": """select doc_id::varchar as id, doc_id as number, 'https://example.com/' || source || '/' || doc_id as url, left(split_part(text, chr(10), 1), 160) as title, source,
        case lang when 'en' then 'world' when 'fr' then 'tech' when 'de' then 'finance' else 'other' end as category, text as content_text, lang,
        timestamp '2024-01-31 00:00:00' - to_hours((doc_id * 37) % 1200) as published_at, timestamp '2024-01-31 00:00:00' - to_days((((doc_id * 37) % 1200) // 24)::int) as fetched_at,
        case when doc_id % 11 = 0 then 'book' else 'rss' end as origin, case when doc_id % 11 = 0 then doc_id // 11 + 1 end as chapter_no, case when doc_id % 3 = 0 then 'summary ' || doc_id else '' end as summary,
        len(regexp_extract_all(text, '\\S+')) as word_count, coalesce(open_count, 0) as open_count, last_opened_at, coalesce(dwell_ms, 0) as dwell_ms, coalesce(read_completed, false) as read_completed,
        doc_id in (select doc_id from labels where quality = 1 and toxic = 0) as liked from documents left join activity on doc_id = article_id""",
    "feeds": """select 'feed-' || source as id, source as name, category, 'https://example.com/' || source || '/rss' as url, number % 5 <> 4 as enabled, case when number % 3 = 0 then 'user' else 'curated' end as origin,
        case when number % 7 = 6 then 'book' else 'rss' end as kind, (case when number < 10 then number % 4 else 0 end)::bigint as priority, number / 20.0 - case when number % 6 = 5 then 2.0 else 0.0 end as fulltext_ratio,
        latest - to_days(case when number % 8 = 7 then 31 else 0 end) as last_new_article_at, n_articles from (select source, arg_max(category, {'n': n, 'c': category}) as category, max(latest) as latest, sum(n)::bigint as n_articles, regexp_extract(source, '([0-9]+)$', 1)::int as number
        from (select source, category, count(*) as n, max(published_at) as latest from articles group by all) group by source)""",
    "words": """select unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]*'), lambda t: length(t) >= 2)) as term from documents where lang = 'en'""",
    "lexicon": "select term, n, row_number() over (order by n desc, term) as rank from (select term, count(*) as n from words group by term)",
    "phrases": """select distinct replace(lower(array_to_string(w[1:number % 4 + 2], ' ')), '’', '''') as key from (select number, regexp_extract_all(title, '[A-Za-z][A-Za-z''’-]*') as w from articles where lang = 'en') where len(w) >= number % 4 + 2""",
    "entries": """select * replace (case when number % 23 = 3 then 'Weekly links: ' || title else title end as title, case when number % 41 = 7 then timestamp '2024-01-31 00:00:00' - to_days(40) else published_at end as published_at,
        (case when number % 19 = 2 then 'Skip to main content' || chr(10) else '' end) || content_text || (case when number % 17 = 1 then ' Continue reading…' else '' end) || (case when number % 29 = 4 then ' Subscription required.' else '' end)
        || (case when number % 31 = 5 then repeat(' 12:34', 20) else '' end) || (case when number % 37 = 6 then repeat(' https://x.example', word_count // 8 + 1) else '' end) as content_text) from articles""",
    "memory": """select 'm' || rank as id, case when rank % 5 = 0 then 'phrase' else 'word' end as kind, case when rank % 5 = 0 then term || ' up' else term end as term, case when rank % 4 = 0 then '' else 'gloss of ' || term end as definition,
        case when rank % 5 = 0 then 'phrase' when rank % 3 = 0 then '' else 'n/v' end as word_type, case when rank % 2 = 0 then '["' || term || ' on","in use"]' when rank % 7 = 0 then 'broken' else '[]' end as collocations_json,
        case when rank % 6 = 0 then '=sum' else 'see ' || term end as context_sentence, case when rank % 3 = 0 then 'mastered' else 'learning' end as status, (rank % 40)::varchar as article_id,
        timestamp '2024-01-31 00:00:00' - to_hours(rank) as created_at from lexicon where rank between 50 and 249""",
}
_NEEDS = {"articles": ("activity",), "feeds": ("articles",), "lexicon": ("words",), "phrases": ("articles",), "entries": ("articles",), "memory": ("lexicon",)}


def with_views(*names: str, sql: str) -> str:
    """`sql` behind the common table expressions that the named views need."""
    found: dict[str, None] = {}

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            add(other)
        found[name] = None

    for name in names:
        add(name)
    return "with " + ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in found) + (", " + sql[5:] if sql.startswith("with ") else " " + sql)
