"""Texts in spans of phrases, words and what stands between: a longest-match join of all texts with all phrases.

Word windows meet phrases by their whole key, after their first two words have met; where several match at one place the
longest is taken, and places go from left to right. Of lexicon and phrases only the frequent words are collected.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .dedup import _cut

WORD = r"[A-Za-z][A-Za-z'’-]*"
LONGEST = 6
#: Phrases of so many bytes, and so many words by rank, are sent to all executors; more are joined by shuffling.
BROADCAST_BYTES, FREQUENT = 16 << 20, 200_000
#: Up to so many phrases are sent as 64-bit hashes, with those of their beginnings.
MARKS = 2_000_000
#: Places of phrases are numbers: a word's place times this, and the phrase's length. Rows that are given out at a time.
PLACES, OUT_ROWS = 8, 20_000
SPACES = " \t\n\x0b\f\r"
_SPLIT = re.compile(f"({WORD})")


def folded(word: Column) -> Column:
    """A word as keys have it."""
    return F.translate(F.lower(word), "’", "'")


def phrase_key(text: Column) -> Column:
    """The words of a phrase with single spaces between; what stands between them doesn't count."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), folded), " ")


def _tokens(texts: DataFrame) -> DataFrame:
    """id, i and keys (the word at i and those that follow it after nothing but white space, LONGEST at most)."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = texts.filter("id is not null and text is not null").select("id", F.transform(words, folded).alias("words"), F.transform(F.split("text", WORD, -1), lambda g: g.rlike(r"^\s+$")).alias("joined"))

    def window(word: Column, i: Column) -> Column:
        # the first gap behind it that is more than white space ends a word's window
        broken = F.array_position(F.slice("joined", i + 2, F.lit(LONGEST - 1)), F.lit(False))
        return F.slice("words", i + 1, F.when(broken == 0, LONGEST).otherwise(broken.cast("int")))

    each = cut.select("id", F.posexplode(F.transform("words", window)).alias("i", "keys"))
    return each.select("id", "i", F.get("keys", F.lit(0)).alias("word"), "keys")



def longest_matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, i, n and key of the phrases (column key) in texts (id, text), by leftmost-longest choice."""
    keyed = phrases.select("key").filter("key <> ''").distinct().withColumn("n", F.size(F.split("key", " "))).filter(F.col("n") <= LONGEST)
    keyed = _cut(keyed)
    size = keyed.agg(F.sum(F.octet_length("key") + 32).alias("bytes"), F.collect_set("n").alias("lengths")).first()
    sent = F.broadcast if (size["bytes"] or 0) <= BROADCAST_BYTES else (lambda df: df)
    # all phrases begin with at least so many words, so windows that begin otherwise go before they are spelled out
    lengths = sorted(size["lengths"]) or [1]
    head = min(2, lengths[0])
    first = keyed.select(F.substring_index("key", " ", head).alias("head")).distinct()
    begun = _tokens(texts).filter(F.size("keys") >= head).withColumn("head", F.array_join(F.slice("keys", 1, head), " ")).join(sent(first), "head", "left_semi")
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.size("keys"))
    windows = begun.select("id", "i", F.explode(F.transform(fitting, lambda n: F.array_join(F.slice("keys", F.lit(1), n), " "))).alias("key"))
    found = windows.join(sent(keyed), "key").groupBy("id", "i").agg(F.max(F.struct("n", "key")).alias("m")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "m.n", "m.key"))).alias("all"))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<i:int,n:int,key:string>>").alias("kept"))
    step = lambda s, m: F.when(m["i"] >= s["end"], F.struct((m["i"] + m["n"]).alias("end"), F.array_append(s["kept"], m).alias("kept"))).otherwise(s)
    chosen = found.select("id", F.inline(F.aggregate("all", empty, step)["kept"]))
    return chosen.select("id", "i", "n", "key")


def annotate(texts: DataFrame, lexicon: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, idx, type (phrase, word or text), text, key, rank: spans that give every text (id, text) back.

    Known words (term, rank) outside phrases are spans of their own; everything else is text. Texts without id or text
    have no spans; ids are unique. Texts are moved once; of their words only those move that may begin a phrase or that
    aren't among the frequent ones.
    """
    whole = texts.filter("id is not null and text is not null").select("id", "text")
    ranked = _cut(lexicon.filter("term is not null and rank is not null").groupBy(F.col("term").alias("word")).agg(F.min("rank").alias("rank")))
    often = ranked.filter(F.col("rank") <= FREQUENT)
    often = often if often.count() <= FREQUENT else often.limit(0)  # ranks that many words share: all words are joined
    frequent = texts.sparkSession.sparkContext.broadcast({r["word"]: r["rank"] for r in often.collect()})
    rest = ranked.join(F.broadcast(often.select("word")), "word", "left_anti")
    hints = _cut(_hints(whole, rest, often, phrases))
    rare = hints.select("id", F.explode("seldom").alias("word")).join(rest, "word").groupBy("id").agg(F.collect_list(F.struct("word", "rank")).alias("rare"))
    rows = whole.join(hints.select("id", "places"), "id", "left").join(rare, "id", "left").select("id", "text", "places", F.col("rare.word").alias("rare_words"), F.col("rare.rank").alias("rare_ranks"))
    id_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("idx", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("rank", T.IntegerType())])
    return rows.mapInArrow(_speller(frequent, to_arrow_type(id_type)), out)


def _hints(texts: DataFrame, rest: DataFrame, often: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, places (of all phrases in a text: PLACES * word + length) and seldom (its words that aren't in `often` but may be in `rest`).

    Hashes of phrases and of their first two words are sent along up to a bound, so that windows that are no phrase go
    before they are moved. Keys of few phrases are sent too and decide; those of more are decided by 128 bits of hashes,
    and those beyond the bound meet the windows by shuffling.
    """
    keyed = _cut(phrases.select("key").filter("key <> ''").distinct().withColumn("n", F.size(F.split("key", " "))).filter(F.col("n") <= LONGEST))
    size = keyed.agg(F.sum(F.octet_length("key") + 32).alias("bytes"), F.collect_set("n").alias("lengths"), F.count(F.lit(1)).alias("count")).first()
    least = rest.agg(F.min(F.char_length("word"))).first()[0]
    lengths = sorted(size["lengths"])
    head, most = min(2, *lengths, 2), max([1, *lengths])
    # a word with one space behind it if the next word follows after nothing but white space; expressions over each word
    # stay small, as a method that is too long isn't compiled
    words = F.regexp_extract_all(_folded_text(F.col("text")), F.lit("[a-z][a-z'-]*(?: (?= *+[a-z]))?"), F.lit(0))
    shifted = [F.slice("w0", k + 1, F.size("w0")).alias(f"w{k}") for k in range(1, most)]
    rows = texts.select("id", words.alias("w0")).select("id", F.posexplode(F.arrays_zip("w0", *shifted)).alias("i", "w"))
    rows = rows.select("id", "i", "w", F.rtrim("w.w0").alias("word"))
    rows = rows.join(F.broadcast(often.select("word", F.lit(True).alias("often"))), "word", "left")
    seldom = F.col("often").isNull() & (F.char_length("word") >= least) if least else F.lit(False)
    marked = bool(lengths) and size["count"] <= MARKS
    if marked:
        marks = keyed.select(F.explode(F.array(F.xxhash64("key"), F.xxhash64(F.substring_index("key", " ", head)))).alias("mark")).distinct()
        marks = F.broadcast(marks.withColumn("hit", F.lit(True)))
        begun = F.col("word") if head == 1 else F.concat("w.w0", F.rtrim("w.w1"))
        rows = rows.withColumn("mark", F.xxhash64(begun)).join(marks, "mark", "left").drop("mark")
    hit = F.col("hit").isNotNull() if marked else F.lit(bool(lengths))
    kept = rows.filter(seldom | hit).select("id", "i", F.array(*(F.col(f"w.w{k}") for k in range(most))).alias("w"), F.when(seldom, F.col("word")).alias("word"), hit.alias("hit"))
    # the first word without a space behind it ends a window
    ends = F.array_position(F.transform("w", lambda w: F.coalesce(w.endswith(" "), F.lit(False))), F.lit(False))
    longest = F.when(~F.col("hit"), 0).when(ends == 0, most).otherwise(ends.cast("int"))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.col("longest"))
    spelled = F.transform(fitting, lambda n: F.struct(n.alias("n"), F.rtrim(F.array_join(F.slice("w", F.lit(1), n), "")).alias("key")))
    alone = F.array(F.struct(F.lit(0).alias("n"), F.col("word").alias("key")))
    items = kept.select("id", "i", "w", "word", longest.alias("longest")).select("id", "i", F.explode(F.concat(alone, spelled)).alias("x")).select("id", "i", "x.n", "x.key").filter("key is not null")
    hashes = lambda key: {"mark": F.xxhash64(key), "proof": F.xxhash64(F.lit(1), F.col(key))}
    small = (size["bytes"] or 0) <= BROADCAST_BYTES
    if marked and not small:
        keys = F.broadcast(keyed.select(*(h.alias(f"key_{name}") for name, h in hashes("key").items())).distinct())
        # compared by xor, so that the join is by one number and not by two
        same = (F.col("mark") == F.col("key_mark")) & (F.col("proof").bitwiseXOR(F.col("key_proof")) == 0)
        found = items.withColumns(hashes("key")).join(keys, same, "left").filter("n = 0 or key_mark is not null")
    else:
        if marked:
            items = items.withColumn("mark", F.xxhash64("key")).join(marks, "mark", "left").filter("n = 0 or hit is not null").drop("mark", "hit")
        whole = keyed.withColumn("known", F.lit(True))
        found = items.join(F.broadcast(whole) if small else whole, ["key", "n"], "left").filter("n = 0 or known")
    place = F.when(F.col("n") > 0, F.col("i").cast("long") * PLACES + F.col("n"))
    return found.groupBy("id").agg(F.collect_list(place).alias("places"), F.collect_set(F.when(F.col("n") == 0, F.col("key"))).alias("seldom"))


def _folded_text(text: Column) -> Column:
    """A text in lower case, its words folded and its white space all spaces; what isn't part of a word stays no part of one."""
    for sign, other in (("\u212a", "."), ("\u0130", "."), ("’", "'"), *((x, " ") for x in SPACES[1:])):  # a Kelvin sign and a dotted I would become letters
        text = F.replace(text, F.lit(sign), F.lit(other))
    return F.lower(text)


def _speller(frequent, id_type: pa.DataType):
    """Spans of each text, by the places of its phrases (PLACES * word + length) and the ranks of its words."""

    def spelled(batches):
        names = ("id", "idx", "type", "text", "key", "rank")
        types = (id_type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for name, text, places, words, ranks in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                spans = _spans(text, places or (), dict(zip(words or (), ranks or (), strict=True)), frequent.value)
                for column, values in zip(out[2:], spans, strict=True):
                    column.extend(values)
                out[0].extend([name] * len(spans[0]))
                out[1].extend(range(len(spans[0])))
                if len(out[0]) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                    out = ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return spelled


def _spans(text: str, places: list[int], rare: dict[str, int], frequent: dict[str, int]) -> tuple[list, list, list, list]:
    """Types, texts, keys and ranks of one text's spans, from left to right: the longest phrase, else a known word, else text."""
    pieces = _SPLIT.split(text)  # a gap, a word, a gap, ... so word i is piece 2i + 1
    count = len(pieces) // 2
    keys = "\n".join(pieces[1::2]).lower().replace("’", "'").split("\n")
    longest = {p // PLACES: p % PLACES for p in sorted(places)}
    types, texts, found, ranks = [], [], [], []
    i = past = 0  # past: the first piece that no span has
    while i < count:
        n, rank = longest.get(i), None
        if not n:
            rank = frequent.get(keys[i])
            if rank is None:
                rank = rare.get(keys[i])
                if rank is None:
                    i += 1
                    continue
        at, end = 2 * i + 1, 2 * (i + (n or 1))
        gap = pieces[past] if past == at - 1 else "".join(pieces[past:at])
        if gap:
            types.append("text")
            texts.append(gap)
            found.append(None)
            ranks.append(None)
        types.append("phrase" if n else "word")
        texts.append("".join(pieces[at:end]) if n else pieces[at])
        found.append(" ".join(keys[i : i + n]) if n else keys[i])
        ranks.append(rank)
        i, past = i + (n or 1), end
    gap = "".join(pieces[past:])
    if gap:
        types.append("text")
        texts.append(gap)
        found.append(None)
        ranks.append(None)
    return types, texts, found, ranks
