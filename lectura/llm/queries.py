"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, impact, langid, lm, outliers, pii, repeats, simhash, txlog, urlfilter, wordbpe
from .common import read

#: (verdict, rule): the host of a rule ends at its first slash.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def surrogate_key(spark: SparkSession) -> str:
    """The session's secret for surrogates; one that is no secret where none is set, as in tests."""
    return spark.conf.get("spark.lectura.surrogateKey", "no secret")


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the strings of 100 bytes that occurred earlier."""
    kept = repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return kept.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url's host, path, deciding rule and verdict."""
    judged = urlfilter.filter_urls(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint and component of near duplicates."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's counts and verdict."""
    judged = outliers.reject_outliers(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("d2"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted in windows and read back from them."""
    table = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    types = dict(table.dtypes)
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string").select(*(F.col(c).cast(types[c]) for c in table.columns))
    return chat.digests(chat.windows(table.unionByName(planted)))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score by the base and by the model, learned from the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0)
    return lm.learn_and_score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates for personal data."""
    done = pii.replace_private(read(spark, sf_dir, "documents", "doc_id", "text"), surrogate_key(spark))
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.to_json("entities").alias("entities"))


def op8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with an item of the benchmark, and the item."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded from its ids."""
    coded = bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


SQL_OP12 = r"""
with split as (select doc_id, row_number() over () as d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
asked as (select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select distinct item_id, text from benchmark)),
wanted as (select item_id, text, term, count(*) as times from asked group by all),
totals as (select count(*) filter (len(terms) > 0) as n_docs, sum(len(terms))::bigint as n_terms from split),
found as (select d, unnest(terms) as term from split),
tfs as (select d, term, count(*) as tf from found where term in (select term from wanted) group by all),
weights as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from tfs, totals group by term),
lengths as (select doc_id, d, 100 - 75 + (75 * len(terms) * n_docs) // n_terms as m from split, totals where len(terms) > 0),
scores as (select item_id, text, doc_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from wanted join tfs using (term) join weights using (term) join lengths using (d) group by all),
ranked as (select item_id, row_number() over (partition by item_id, text order by score desc, doc_id asc nulls first)::int as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 10"""

#: Bytes as pairs of hex digits; every string of 100 bytes by where it starts.
SQL_OP1 = """
with hexed as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select doc_id, unnest(range(1, length(h) // 2 - 98)) as p, h from hexed),
strings as (select doc_id, p, substr(h, 2 * p - 1, 200) as s from starts),
firsts as (select *, row_number() over (partition by s order by doc_id, p) > 1 as later from strings),
marked as (select distinct doc_id, unnest(range(p, p + 100)) as i from firsts where later),
runs as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as island from marked),
spans as (select doc_id, count(distinct island) as n_spans, count(*) as n_removed, list(i) as gone from runs group by doc_id),
letters as (select doc_id, h, unnest(range(1, length(h) // 2 + 1)) as i from hexed),
kept as (select l.doc_id, string_agg(substr(l.h, 2 * l.i - 1, 2), '' order by l.i) as k from letters l anti join marked m on l.doc_id = m.doc_id and l.i = m.i group by l.doc_id)
select d.doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from hexed d left join spans s on d.doc_id = s.doc_id left join kept k on d.doc_id = k.doc_id"""


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learned from the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_undo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a log of transactions: the store after each epoch of commits, and every change that was undone."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    turn = F.col("h") % 41
    kind = F.when(turn <= 1, "commit").when(turn == 2, "abort").when(turn <= 4, "savepoint").when(turn <= 6, "rollback").otherwise("change")
    docs = docs.withColumns({"kind": kind, "key": F.floor(F.col("h") / 100).cast("long") % 3000})
    docs = docs.select("doc_id", "source", "kind", "key", F.when(F.col("kind") == "change", F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("text")).cast("binary"))).alias("said"))
    toxic = read(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1").select("doc_id", F.lit(True).alias("gone")).distinct()
    log = docs.join(toxic, "doc_id", "left").select(F.col("doc_id").alias("at"), "source", "kind", "key", F.when(F.col("gone").isNull(), F.col("said")).alias("value"))
    changes, commits = txlog.reassemble(log)
    stored = txlog.states(changes, commits).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value"))
    return stored.unionByName(changes.filter("what <> 'commit'").select(F.col("what").alias("kind"), F.col("at").alias("id"), F.col("by").alias("n"), F.col("key").alias("value")))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each item of the benchmark."""
    return impact.search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by words, and decoded from its ids."""
    coded = wordbpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded="decoded", keep_text=False)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _nibble_table() -> list[int]:
    """CRC-32 of half a byte."""
    found = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        found.append(n)
    return found


def _sql_crc32(value: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, half a byte at a time."""
    half = lambda c: f"xor({c} >> 4, {_nibble_table()}[(({c} & 15) + 1)::int])"
    octets = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: {half(half('xor(c, b)'))}, 4294967295::bigint))"


def _sql_op11() -> str:
    return f"""
with h as (select doc_id, coalesce('+' || source, '-') as source, text, {_sql_crc32("doc_id::varchar")} as h from documents where doc_id is not null),
kinds as (select *, case when h % 41 <= 1 then 'commit' when h % 41 = 2 then 'abort' when h % 41 <= 4 then 'savepoint' when h % 41 <= 6 then 'rollback' else 'change' end as kind, (h // 100) % 3000 as key from h),
log as (select doc_id, source, kind, key, case when kind = 'change' and text is not null and doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null) then {_sql_crc32("(key || ':' || coalesce(text, ''))")} end as said from kinds),
told as (select *, first_value(case when kind <> 'change' then kind end ignore nulls) over later as mark, first_value(case when kind <> 'change' then doc_id end ignore nulls) over later as mark_id,
  first_value(case when kind in ('commit', 'abort') then kind end ignore nulls) over later as last, first_value(case when kind in ('commit', 'abort') then doc_id end ignore nulls) over later as last_id
  from log window later as (partition by source order by doc_id rows between 1 following and unbounded following)),
commits as (select doc_id as last_id, row_number() over (order by doc_id) - 1 as number from log where kind = 'commit'),
writes as (select key, said, doc_id, number, number // 16 + 1 as epoch from told join commits using (last_id) where kind = 'change' and last = 'commit' and mark <> 'rollback'),
epochs as (select distinct number // 16 + 1 as epoch from commits),
stored as (select e.epoch, key, arg_max({{'v': said}}, {{'n': number, 'd': doc_id}}).v as v from epochs e join writes w on w.epoch <= e.epoch group by all)
select 'state' as kind, e.epoch::bigint as id, count(v)::bigint as n, coalesce(sum(v), 0)::bigint as value from epochs e left join stored s on s.epoch = e.epoch group by e.epoch
union all select case when mark = 'rollback' then 'rollback' else 'abort' end, doc_id, case when mark = 'rollback' then mark_id else last_id end, key::bigint from told where kind = 'change' and (coalesce(mark, '') = 'rollback' or coalesce(last, 'abort') = 'abort')"""


def _sql_host_path(url: str) -> tuple[str, str]:
    host = f"coalesce(translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    return host, f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _sql_op2() -> str:
    host, path = _sql_host_path("url")
    edge, end = "(^|[^\\pL\\pN])", "($|s$|s?[^\\pL\\pN])"
    hit = lambda t: f"(regexp_matches(place, '{edge}{t}{end}'))::int"
    stem = lambda t: f"(regexp_matches(place, '{edge}{t}|{t}{end}'))::int"
    total = lambda terms: " + ".join(hit(t) for t in terms)
    strict = total(urlfilter.STRICT_TERMS) + " + " + " + ".join(stem(t) for t in urlfilter.STRICT_STEMS)
    cases = ""
    for _, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        cases += f" when (host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '{slash + rest}') then '{rule}'"
    verdicts = " ".join(f"when '{rule}' then '{verdict}'" for verdict, rule in URL_RULES)
    return f"""
with cut as (select page_id, {host} as host, {path} as path from pages),
hits as (select *, lower(host || path) as place, case{cases} end as rule from cut),
counted as (select *, ({strict})::int as n_strict, ({total(urlfilter.SUSPECT_TERMS)})::int as n_two, ({total(urlfilter.SOFT_TERMS)})::int as n_one from hits),
weighed as (select *, (n_two + n_one)::int as n_soft, ({urlfilter.NEEDED} * n_strict + 2 * n_two + n_one)::int as weight from counted)
select page_id, host, path, rule, case rule {verdicts} else case when weight >= {urlfilter.NEEDED} then 'block' else 'allow' end end as verdict, n_strict, n_soft, weight from weighed"""


def _sql_op5() -> str:
    budget, history = chat.BUDGET, chat.HISTORY
    return f"""
with recursive raw as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
numbered as (
  select *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as tokens,
    row_number() over (partition by conv_id order by turn asc nulls first, role, text) as n,
    length(text) + (length(text) - length(replace(text, '\\', ''))) + (length(text) - length(replace(text, '<', ''))) as body,
    length(role) + (length(role) - length(replace(role, '\\', ''))) + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, '>', ''))) + (length(role) - length(replace(role, chr(10), ''))) as name from raw),
sized as (select *, (n = 1 and role = 'system') as sys, body + name + 6 + 2 + 9 as chars from numbered),
upto as (
  select *, {budget} - coalesce(max(case when sys then tokens end) over (partition by conv_id), 0) as room,
    sum(case when sys then 0 else tokens end) over (partition by conv_id order by n) as total from sized),
cuts as (
  select conv_id, 1::bigint as n, 0::bigint as span, 0::hugeint as before, room from upto where n = 1
  union all
  select c.conv_id, min(u.n), c.span + 1, min(u.total - case when u.sys then 0 else u.tokens end), c.room
  from cuts c join upto u on u.conv_id is not distinct from c.conv_id and u.n > c.n
    and (u.total - c.before > c.room - case when c.span = 0 then 0 else {history} end or (u.n - 1) % {chat.BLOCK} = 0)
  group by c.conv_id, c.span, c.room),
ends as (select *, lead(n) over (partition by conv_id order by span) as next_n from cuts),
spans as (select u.*, e.span, e.next_n from upto u join ends e on u.conv_id is not distinct from e.conv_id and u.n >= e.n and (e.next_n is null or u.n < e.next_n)),
sums as (select conv_id, span, max(total) as last_total, sum(case when sys then 0 else tokens end) as own from spans group by all),
placed as (
  select s.*, not s.sys and x.own is not null and m.last_total - s.total + s.tokens <= least({history}, s.room - x.own) as again
  from spans s join sums m on m.conv_id is not distinct from s.conv_id and m.span = s.span
    left join sums x on x.conv_id is not distinct from s.conv_id and x.span = s.span + 1),
sizes as (
  select conv_id, sum(chars * (1 + case when again then 1 else 0 end)) + (count(distinct span) - 1) * coalesce(max(case when sys then chars end), 0) as formatted_chars,
    count(distinct span) as n_windows, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by n), '') as loss
  from placed group by conv_id)
select conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars, n_windows from sizes"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_repeats, op2_url_filter, op3_simhash, op4_outliers, op5_chat_windows, op6_log_bilinear, op7_surrogates, op8_templates, op9_byte_bpe, op10_string_kernel, op11_undo_log, op12_impact_search, op13_word_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_repeats": SQL_OP1, "op2_url_filter": _sql_op2(), "op5_chat_windows": _sql_op5(), "op11_undo_log": _sql_op11(), "op12_impact_search": SQL_OP12}
