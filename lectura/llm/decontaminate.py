"""Benchmark decontamination by templates, with DataFrame functions only.

A text becomes a sequence of tokens: words, numbers, names and units. A number is a run of digits with inner `.,:/`;
a unit is a unit word or `%` right behind a number; a name is any other word that begins with a capital letter, also the
first word of a sentence, as no list tells which of these are names. In the template each number, name and unit is a
typed placeholder; other words stand lower-cased.

1. Every window of `WINDOW` tokens of a benchmark item (or the whole item if it is shorter) that holds a letter gets an
   anchor. It is strong if it has at least `LITERALS` words that aren't placeholders (of a shorter item two thirds of
   its tokens, or a third of them if these are `WHOLE` or more); an item without a strong window is dense. The anchor is a pair
   of neighbouring words, the one with the word that fewest of about `SAMPLE` documents hold (a word alone where no two
   words are neighbours). Where only a copy word for word counts (weak windows of items that aren't dense), names are
   words as well. Documents that hold no anchor are out; which pair serves as anchor, and so the sample, has no influence
   on what is found.
2. The windows around the anchors of the remaining documents are hash-joined with the benchmark's: all by their
   lower-cased tokens as they are, strong ones and those of dense items also by their templates.
3. Matches on one diagonal (place in the document less place in the item) form a run. Over a run each slot value of the
   item must stand for one and the same value of the document, and the run must hold a strong window, or, of a dense
   item, `LITERALS` words in all. A run that fails this counts by its strong windows if these alone don't fail it, or
   else only by its windows that are the item's word for word.

Defined results: null and empty texts match nothing; texts are searched whole; repeated rows and items match alike and
are listed once a pair of ids; rows and items with a null id are never listed, but `drop_contaminated` judges such rows
by their text and takes such items into account; empty tables give no matches; other columns are ignored. U+E000 to
U+E002 in a text act as placeholders. An item without any letter (numbers only) matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, cut, unused

WINDOW, LITERALS, WHOLE, SAMPLE = 10, 6, 3, 2000
#: Benchmark windows up to this many (of under 1 kB each, but for words of unusual length) are sent to all executors;
#: more are joined by shuffling, each window dealt to this many places, so that a template that very many documents hold
#: is not one task's work.
BROADCAST_WINDOWS, PLACES = 100_000, 16
#: Ids of documents with an anchor, and the numbers of their words that begin one, up to these many are sent to all
#: executors (under 50 MB); more are joined by shuffling.
BROADCAST_IDS, BROADCAST_WORDS = 1_000_000, 4_000_000
NUMBER, NAME, UNIT = "", "", ""
UNITS = (
    "mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles", "mg", "g", "kg", "t", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds", "ml", "cl", "l", "liter", "liters", "litre", "litres",
    "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
    "degrees", "kw", "kwh", "w", "v", "hz", "mph", "kb", "mb", "gb",
)


def tokens(text: Column) -> Column:
    """array<string> of a text's tokens, lower-cased, with their type's mark in front of numbers, names and units."""
    unit = "|".join(sorted(UNITS, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(rf"\p{{N}}+(?:[.,:/]\p{{N}}+)*(?:\s?(?:%|(?i:{unit})(?![\p{{L}}\p{{N}}])))?|[\p{{L}}\p{{M}}]+"), F.lit(0))
    rare = lambda t: F.ascii(t) > 127
    number = lambda t: F.ascii(t).between(48, 57) | (rare(t) & F.substring(t, 1, 1).rlike(r"\p{N}"))
    capital = lambda t: F.ascii(t).between(65, 90) | (rare(t) & (F.lower(F.substring(t, 1, 1)) != F.substring(t, 1, 1)))
    single = lambda t: F.when(number(t), F.concat(F.lit(NUMBER), F.lower(t))).when(capital(t), F.concat(F.lit(NAME), F.lower(t))).otherwise(F.lower(t))
    with_unit = lambda t: number(t) & t.rlike(r"[%\p{L}]$")
    both = lambda t: F.array(F.concat(F.lit(NUMBER), F.regexp_extract(F.lower(t), r"^[\p{N}.,:/]*\p{N}", 0)), F.concat(F.lit(UNIT), F.regexp_extract(F.lower(t), r"(?:%|\p{L}+)$", 0)))
    split = lambda f: F.when(F.exists(f, with_unit), F.flatten(F.transform(f, lambda t: F.when(with_unit(t), both(t)).otherwise(F.array(single(t)))))).otherwise(F.transform(f, single))
    return F.coalesce(bind(found, split), F.array().cast("array<string>"))


def template(marked: Column) -> Column:
    """Placeholders for the marked tokens."""
    return F.transform(marked, lambda t: F.when(F.ascii(t).between(0xE000, 0xE002), F.substring(t, 1, 1)).otherwise(t))


def plain_words(text: Column) -> Column:
    """All runs of letters of a text in order, lower-cased: the tokens but for numbers and `%`."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))


def raw_of(marked: Column) -> Column:
    """The tokens without their marks."""
    return F.transform(marked, lambda t: F.when(F.ascii(t).between(0xE000, 0xE002), F.substring(t, 2, 1 << 30)).otherwise(t))


def _hash(form: Column, at: Column, size: int, kind: int) -> Column:
    """A hash of the window of a form (kind 0: template, 1: as it is) that begins at a place from 0."""
    return F.xxhash64(F.lit(kind), *(F.get(form, at + k) for k in range(size)))


def _placed(df: DataFrame, size: int) -> DataFrame:
    """doc_id, at and hash, of both kinds, of each window that holds a word (of columns form and raw) at one of `places`."""
    last = F.size("form") - size
    around = lambda k: F.sequence(F.greatest(k - size + 1, F.lit(0)), F.least(k, last))
    starts = F.when(last >= 0, F.array_distinct(F.flatten(F.transform(F.filter("places", lambda k: k - size + 1 <= last), around))))
    of = lambda form, kind: F.transform("starts", lambda i: F.struct(i.alias("at"), _hash(F.col(form), i, size, kind).alias("hash")))
    return df.withColumn("starts", starts).select("doc_id", F.explode(F.concat(of("form", 0), of("raw", 1))).alias("w")).select("doc_id", "w.at", "w.hash")


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """item_id, size, at, slots, words (those that aren't placeholders), strong (enough words) and dense of each window with a letter."""
    marked = items.select(F.col(item_id).alias("item_id"), tokens(F.col(text)).alias("marked")).filter("item_id is not null and size(marked) > 0")
    marked = marked.dropDuplicates(["item_id", "marked"]).withColumn("size", F.least(F.size("marked"), F.lit(window)))
    starts = F.sequence(F.lit(0), F.size("marked") - F.col("size"))
    cut = marked.select("item_id", "size", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("marked", i + 1, F.col("size")).alias("slots")))).alias("w")).select("item_id", "size", "w.at", "w.slots")
    words = F.filter("slots", lambda t: ~F.ascii(t).between(0xE000, 0xE002))
    needed = F.when(F.col("size") == window, F.lit(literals)).otherwise(F.ceil(F.col("size") * 2 / 3))
    third = (F.col("size") < window) & (F.size("words") >= WHOLE) & (F.size("words") * 3 >= F.col("size"))
    held = cut.withColumn("words", words).filter(F.exists("slots", lambda t: F.ascii(t) != ord(NUMBER)))
    held = held.withColumn("strong", (F.size("words") >= needed) | third)
    return held.withColumn("dense", ~F.max("strong").over(Window.partitionBy("item_id")))  # an item has few windows


def _pairs(words: Column) -> Column:
    """A hash of each pair of neighbouring words."""
    ends = lambda w: F.sequence(F.lit(0), F.size(w) - 2)
    return bind(words, lambda w: F.when(F.size(w) > 1, F.transform(ends(w), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.expr("cast(array() as array<bigint>)")))


def anchors_of(windows: DataFrame, rows: DataFrame, small, sample: int = SAMPLE) -> DataFrame:
    """Distinct `anchor` hashes of pairs of words, and of words (`alone`) where a window has no such pair."""
    step = max(1, rows.count() // sample)
    # a window that counts as it is only may be looked for by its names too
    bare = F.transform("slots", lambda t: F.when(F.ascii(t) == ord(NUMBER), t).otherwise(F.translate(t, NAME + UNIT, "")))
    windows = windows.withColumn("slots", F.when((F.col("strong") | F.col("dense")) & (F.size("words") > 0), F.col("slots")).otherwise(bare))
    each = windows.select("item_id", "size", "at", F.posexplode("slots").alias("k", "word"), "slots").filter(~F.ascii("word").between(0xE000, 0xE002))
    held = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word"))
    seen = held.join(small(each.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    each = each.join(small(seen), "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    behind, before = F.get("slots", F.col("k") + 1), F.get("slots", F.col("k") - 1)
    literal = lambda w: w.isNotNull() & ~F.ascii(w).between(0xE000, 0xE002)
    pair = F.when(literal(behind), F.xxhash64("word", behind)).when(literal(before), F.xxhash64(before, F.col("word")))
    anchor = F.struct(F.coalesce(pair, F.xxhash64("word")).alias("anchor"), pair.isNull().alias("alone"))
    order = F.struct(pair.isNull(), "seen", -F.char_length("word"), F.col("word"), F.col("k"))
    return each.groupBy("item_id", "size", "at").agg(F.min_by(anchor, order).alias("a")).select("a.anchor", "a.alone").distinct()


def _these(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with one of the doc_ids, which are written down already."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """doc_id, item_id, n_windows (matched), item_windows (all that could be), n_slots and n_changed (slots whose value differs)."""
    known = cut(benchmark_windows(items, item_id, item_text, window, literals))
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()  # at most `window` sizes
    few = sizes["n"] <= BROADCAST_WINDOWS
    small = F.broadcast if few else (lambda x: x)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    anchors = cut(anchors_of(known, rows, small))
    words = plain_words(F.col("text"))
    hashes = rows.select("doc_id", F.posexplode(_pairs(words)).alias("k", "hash"))
    if not anchors.filter("alone").isEmpty():
        hashes = hashes.unionByName(rows.select("doc_id", F.posexplode(words).alias("k", "word")).select("doc_id", "k", F.xxhash64("word").alias("hash")))
    # of each document the numbers of the words with which an anchor begins
    near = cut(hashes.join(small(anchors), F.col("hash") == F.col("anchor"), "left_semi").groupBy("doc_id").agg(F.collect_set("k").alias("words")))
    size = near.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words")).first()
    light = size["n"] <= BROADCAST_IDS and (size["words"] or 0) <= BROADCAST_WORDS
    marked = rows.join(F.broadcast(near) if light else near, "doc_id").select("doc_id", "words", tokens(F.col("text")).alias("marked"))
    spelled = F.filter(F.transform("marked", lambda t, i: F.when((F.ascii(t) != ord(NUMBER)) & (t != UNIT + "%"), i)), lambda i: i.isNotNull())
    formed = marked.select("doc_id", template(F.col("marked")).alias("form"), raw_of(F.col("marked")).alias("raw"), bind(spelled, lambda w: F.transform("words", lambda k: F.get(w, k))).alias("places"))
    formed = formed.withColumn("places", F.filter("places", lambda k: k.isNotNull()))
    met = None
    for size in sorted(sizes["sizes"] or [window]):
        of = known.filter(F.col("size") == size).withColumns({"form": template(F.col("slots")), "raw": raw_of(F.col("slots"))})
        both = F.array(F.when((F.col("strong") | F.col("dense")) & (F.size("words") > 0), _hash(F.col("form"), F.lit(0), size, 0)), _hash(F.col("raw"), F.lit(0), size, 1))
        of = of.select("item_id", F.col("at").alias("item_at"), F.explode(both).alias("item_hash")).filter("item_hash is not null")
        every, same = _placed(formed, size), F.col("hash") == F.col("item_hash")
        if not few:
            every = every.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)))
            of = of.withColumn("item_place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLACES - 1).cast("long"))))
            same = same & (F.col("place") == F.col("item_place"))
        found = every.join(small(of), same).select("doc_id", "at", "item_id", "item_at", F.lit(size).alias("size"))
        met = found if met is None else met.unionByName(found)
    met = cut(met.distinct())
    # the tokens where windows met, taken from each text once
    places = met.groupBy("doc_id").agg(F.collect_set(F.struct("at", "size")).alias("places"))
    texts = _these(rows, cut(places.select("doc_id"))).select("doc_id", tokens(F.col("text")).alias("marked")).join(places, "doc_id")
    taken = texts.select("doc_id", F.explode(F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), F.slice("marked", p["at"] + 1, p["size"]).alias("slots")))).alias("w")).select("doc_id", "w.*")
    of = known.select("item_id", F.col("at").alias("item_at"), "size", F.col("slots").alias("item_slots"), "strong", "dense", ((F.col("strong") | F.col("dense")) & (F.size("words") > 0)).alias("by_form"))
    met = met.join(taken, ["doc_id", "at", "size"]).join(small(of), ["item_id", "item_at", "size"])
    as_is = raw_of(F.col("slots")) == raw_of(F.col("item_slots"))
    met = met.withColumn("as_is", as_is).filter(F.col("as_is") | (F.col("by_form") & (template(F.col("slots")) == template(F.col("item_slots")))))
    pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), F.when(F.col("as_is"), a).otherwise(b).alias("b"))), lambda z: F.ascii(z["a"]).between(0xE000, 0xE002))
    places = F.filter(F.transform("item_slots", lambda t, k: F.when(~F.ascii(t).between(0xE000, 0xE002), F.col("item_at") + k)), lambda x: x.isNotNull())
    met = met.select("doc_id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"), "strong", "dense", places.alias("places"))
    # a group holds at most one item's windows
    all_same = F.forall("pairs", lambda z: z["a"] == z["b"])
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    run = met.groupBy("doc_id", "item_id", "shift").agg(
        F.count_distinct("item_at").alias("all"), F.count_distinct(F.when(all_same, F.col("item_at"))).alias("same"), F.max("strong").alias("strong"), F.max("dense").alias("dense"),
        F.count_distinct(F.when(F.col("strong"), F.col("item_at"))).alias("n_strong"), distinct(F.when(F.col("strong"), F.col("pairs"))).alias("firm"), F.size(distinct(F.col("places"))).alias("literals"), distinct(F.col("pairs")).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.a")))
    firm = F.when(F.size("firm") == F.size(F.array_distinct(F.col("firm.a"))), F.col("n_strong")).otherwise(0)  # weak windows take nothing from strong ones
    enough = F.col("strong") | (F.col("dense") & (F.col("literals") >= literals))
    run = run.withColumns({"n": F.when(consistent & enough, F.col("all")).otherwise(F.greatest("same", firm)), "n_slots": F.size("pairs"), "n_changed": F.size(F.filter("pairs", lambda z: z["a"] != z["b"]))}).filter("n > 0")
    best = F.max(F.struct("n", "n_slots", "n_changed")).alias("best")
    total = known.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"))
    out = run.groupBy("doc_id", "item_id").agg(best).join(total, "item_id")
    return out.select("doc_id", "item_id", F.col("best.n").cast("long").alias("n_windows"), F.col("item_windows").cast("long").alias("item_windows"), F.col("best.n_slots").cast("long").alias("n_slots"), F.col("best.n_changed").cast("long").alias("n_changed"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", **kwargs) -> DataFrame:
    """The documents that match no item, those without an id included; columns as they are."""
    items = items.select(F.xxhash64(F.coalesce(F.col(item_text), F.lit(""))).alias("item_id"), F.col(item_text).alias("text"))
    name = unused(docs, "found_id")

    def clean(rows: DataFrame, key: str) -> DataFrame:
        found = contaminated(rows, items, key, text, **kwargs).select(F.col("doc_id").alias(name)).distinct()
        return rows.join(found, F.col(key) == F.col(name), "left_anti")

    bare = docs.filter(F.col(doc_id).isNull())
    if bare.isEmpty():
        return clean(docs, doc_id)
    number = unused(docs, "row_number")
    bare = cut(bare.withColumn(number, F.monotonically_increasing_id()))  # written down once, so that numbers stay
    return clean(docs.filter(F.col(doc_id).isNotNull()), doc_id).unionByName(clean(bare, number).drop(number))
