"""Words and their levels: lemma candidates, lookups, article difficulty, calibrated levels, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text

# --- fixed values -----------------------------------------------------------------------------------------------
#: Irregular forms and their base forms.
IRREGULAR = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do",
    "doing": "do", "went": "go", "gone": "go", "goes": "go", "said": "say", "says": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "got": "get", "gotten": "get",
    "saw": "see", "seen": "see", "knew": "know", "known": "know", "gave": "give", "given": "give", "found": "find", "thought": "think", "told": "tell", "became": "become", "left": "leave",
    "felt": "feel", "brought": "bring", "began": "begin", "begun": "begin", "kept": "keep", "held": "hold", "wrote": "write", "written": "write", "stood": "stand", "heard": "hear",
    "let": "let", "meant": "mean", "met": "meet", "ran": "run", "paid": "pay", "sat": "sit", "spoke": "speak", "spoken": "speak", "led": "lead", "grew": "grow", "grown": "grow",
    "lost": "lose", "fell": "fall", "fallen": "fall", "sent": "send", "built": "build", "understood": "understand", "drew": "draw", "drawn": "draw", "broke": "break", "broken": "break",
    "spent": "spend", "cut": "cut", "rose": "rise", "risen": "rise", "drove": "drive", "driven": "drive", "bought": "buy", "wore": "wear", "worn": "wear", "chose": "choose",
    "chosen": "choose", "ate": "eat", "eaten": "eat", "won": "win", "sought": "seek", "threw": "throw", "thrown": "throw", "caught": "catch", "taught": "teach", "dealt": "deal",
    "hid": "hide", "hidden": "hide", "sang": "sing", "sung": "sing", "slept": "sleep", "shot": "shoot", "struck": "strike", "hung": "hang", "bore": "bear", "borne": "bear",
    "children": "child", "men": "man", "women": "woman", "people": "person", "teeth": "tooth", "feet": "foot", "mice": "mouse", "geese": "goose", "lives": "life", "knives": "knife",
    "wives": "wife", "halves": "half", "selves": "self", "leaves": "leaf", "shelves": "shelf", "wolves": "wolf", "thieves": "thief", "data": "datum", "criteria": "criterion",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad", "more": "much", "most": "much", "less": "little", "least": "little", "farther": "far", "farthest": "far",
    "further": "far", "furthest": "far",
}
#: Words of closed classes, which are never names.
CLOSED_CLASS = (
    "a an the and or but nor of to in on at by for from with as that this these those it its is are was were be been being he she they them their i you your we our my me us who which what when where how not no yes"
).split()
#: Hyphenated words whose spaced form usually means something else.
AMBIGUOUS_SPACED = (
    "also ran", "cold blood", "empty hand", "fast track", "know how", "left hand", "red hand", "right hand", "second hand", "single hand", "back up", "check up", "close up",
    "cut off", "head up", "hard work", "make up", "mix up", "one man", "one night", "one time", "pick up", "set up", "stand up", "take off", "wake up",
)
#: What a gloss of a name says.
NAME_GLOSSES = (
    "人名 姓氏 男子名 女子名 男人名 女性名 男名 女名 姓名 姓氏名 姓 地名 城市名 市名 郡名 神话人物 先知 篮球队名 球队名 俱乐部 公司名 电影名 电视剧名 歌手 作家 诗人 总统 国王 女王 公爵 伯爵 男爵 皇后 公主 汉语拼音"
).split()
HONORIFICS = "mr mrs ms miss dr prof st ste sir madam lord lady president senator governor rev hon jr sr vs etc co inc ltd corp dept est fig no vol ed pp al".split()
TITLE_ABBREVIATIONS = "mr mrs ms dr prof st jr sr vs etc no fig inc ltd co".split()
# ----------------------------------------------------------------------------------------------------------------
LEAST_TOKENS, LEAST_SAMPLES, QUANTILES = 40, 40, (0.15, 0.40, 0.70, 0.90)
LOW, HIGH, START, QUESTIONS = 400.0, 25000.0, 3000.0, 50


def normal_key(term: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.trim(term)), "’", "'"), r"\s+", " ")


def irregular(word: Column) -> Column:
    """The base form of an irregular word, else null."""
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    return F.try_element_at(table, word)


#: (ending, least letters before it, replacements; "2" stands for the stem without its doubled last letter) in order of trial.
_ENDINGS = (
    ("'s", 0, ("",)), ("'", 0, ("",)), ("ies", 1, ("y",)), ("ves", 0, ("f", "fe")), ("es", 0, ("",)), ("s", 0, ("",)), ("men", 0, ("man",)), ("ing", 2, ("2", "", "e")), ("ied", 1, ("y",)),
    ("ed", 2, ("2", "", "e")), ("est", 2, ("2", "", "e")), ("er", 2, ("2", "", "e")), ("ly", 3, ("",)), ("ily", 2, ("y",)), ("ly", 3, ("e",)),
)


def lemma_candidates(word: Column) -> Column:
    """array<string> of base forms that a regular ending may come from, likeliest first."""
    out = []
    for ending, least, ways in _ENDINGS:
        stem = F.left(word, F.char_length(word) - len(ending))
        fits = word.endswith(ending) & (F.char_length(word) >= len(ending) + max(least, 1))
        if ending == "s":
            fits = fits & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is")
        doubled = (F.char_length(stem) >= 2) & (F.right(stem, F.lit(1)) == F.substring(stem, -2, 1))
        for way in ways:
            made = F.left(stem, F.char_length(stem) - 1) if way == "2" else F.concat(stem, F.lit(way))
            out.append(F.when(fits & doubled if way == "2" else fits, made))
    usable = (F.char_length(word) >= 3) & ~word.contains(" ")
    kept = F.filter(F.array(*out), lambda c: c.isNotNull() & (c != word) & (F.char_length(c) >= 2))
    return F.when(usable, F.array_distinct(kept)).otherwise(F.expr("cast(array() as array<string>)"))


def looked_up(terms: DataFrame, lexicon: DataFrame, term: str = "term") -> DataFrame:
    """Each distinct term with the entry it stands for: itself, else its first candidate in the lexicon; rank null if there is none."""
    tried = terms.select(F.col(term).alias("term")).distinct().select("term", F.posexplode(F.concat(F.array("term"), lemma_candidates(F.col("term")))).alias("place", "form"))
    entry = lexicon.select(F.col("term").alias("form"), "rank")
    found = tried.join(entry, "form").groupBy("term").agg(F.min_by(F.struct("form", "rank"), "place").alias("hit"))
    return terms.select(F.col(term).alias("term")).distinct().join(found, "term", "left").select("term", F.col("hit.form").alias("entry"), F.col("hit.rank").alias("rank"))


def lemmas(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """term and lemma: irregular table, else a candidate in the lexicon, else the likeliest candidate of an unknown word, else the word."""
    own = lexicon.select("term", F.lit(True).alias("known"))
    tried = terms.select("term").distinct().withColumn("forms", lemma_candidates(F.col("term")))
    hits = tried.select("term", F.posexplode("forms").alias("place", "form")).join(lexicon.select(F.col("term").alias("form")), "form").groupBy("term").agg(F.min_by("form", "place").alias("hit"))
    joined = tried.join(hits, "term", "left").join(own, "term", "left")
    likely = F.when(F.col("known").isNull(), F.get("forms", F.lit(0)))
    return joined.select("term", F.coalesce(irregular(F.col("term")), "hit", likely, "term").alias("lemma"))


def difficulty(articles: DataFrame, lexicon: DataFrame, learning: DataFrame, key: str = "id") -> DataFrame:
    """key, score, avg_sentence_words, coverage of texts with 40 words and more; distinct words meet the lexicon, not every one."""
    sample = articles.select(F.col(key).alias("id"), text.excerpt(F.col("content_text")).alias("t"))
    sample = sample.withColumns({"tokens": text.difficulty_tokens(F.col("t")), "sentences": F.regexp_count("t", F.lit(r"[^.!?]+[.!?]*"))}).filter(F.size("tokens") >= LEAST_TOKENS)
    counted = sample.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    known = looked_up(counted, lexicon)
    mine = learning.select(normal_key(F.col("term")).alias("term")).distinct().withColumn("learning", F.lit(True))
    letters = F.char_length(F.regexp_replace("term", "[^A-Za-z]", ""))
    joined = counted.join(known, "term", "left").join(mine, "term", "left")
    learned = F.coalesce("learning", F.lit(False))
    weight = scoring.word_weight(F.col("rank"), learned, letters >= 7)
    summed = joined.groupBy("id").agg(F.sum(F.col("n") * weight).alias("total"), F.sum("n").alias("n"), F.sum(F.when(learned, F.col("n")).otherwise(0)).alias("covered"))
    per = F.col("n") / F.greatest(F.col("sentences"), F.lit(1))
    out = summed.join(sample.select("id", "sentences"), "id")
    return out.select(F.col("id").alias(key), F.round(F.col("total") / F.col("n") * scoring.sentence_factor(per), 6).alias("score"), F.round(per, 6).alias("avg_sentence_words"), F.round(F.col("covered") / F.col("n"), 6).alias("coverage"))


def calibrated_edges(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row with the array `edges`: halfway between the scores' quantiles and the default ones, rising by 0.001 at least; default ones for few scores."""
    one = scores.filter(F.col(score).isNotNull() & ~F.isnan(score)).agg(F.count(F.lit(1)).alias("n"), F.percentile(score, F.array(*map(F.lit, QUANTILES))).alias("q"))
    default = F.array(*map(F.lit, scoring.DEFAULT_EDGES))
    blended = F.zip_with(F.col("q"), default, lambda a, b: a * 0.5 + b * 0.5)
    start = F.struct(F.lit(0.001).alias("floor"), F.expr("cast(array() as array<double>)").alias("out"))
    rising = F.aggregate(blended, start, lambda s, e: F.struct((F.greatest(e, s["floor"]) + 0.001).alias("floor"), F.concat(s["out"], F.array(F.greatest(e, s["floor"]))).alias("out")), lambda s: s["out"])
    return one.select(F.when(F.col("n") < LEAST_SAMPLES, default).otherwise(F.transform(rising, lambda e: F.round(e, 6))).alias("edges"))


def with_levels(scores: DataFrame, edges: DataFrame) -> DataFrame:
    return scores.crossJoin(F.broadcast(edges)).withColumn("level", scoring.level_of(F.col("score"), F.col("edges"))).drop("edges")  # edges is one row


def placement(answers: DataFrame) -> DataFrame:
    """user_id, ability, band and level after all answers (n, difficulty, correct) in order."""
    steps = F.sort_array(F.collect_list(F.struct("n", "difficulty", "correct")))

    def after(ability: Column, a: Column) -> Column:
        decay = 1 - (a["n"] - 1) / float(QUESTIONS)
        right = ability * (1 + 0.18 * decay) * 0.7 + a["difficulty"] * 1.15 * 0.3
        wrong = ability * (1 - 0.22 * decay) * 0.7 + a["difficulty"] * 0.75 * 0.3
        return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.when(a["correct"], right).otherwise(wrong)))

    one = answers.groupBy("user_id").agg(F.aggregate(steps, F.lit(START), after).alias("ability"))
    band, level = F.lit(scoring.BANDS[-1]), F.lit("C2")
    for k in range(3, -1, -1):
        mid = (scoring.BANDS[k] * scoring.BANDS[k + 1]) ** 0.5
        band, level = F.when(F.col("ability") < mid, scoring.BANDS[k]).otherwise(band), F.when(F.col("ability") < mid, ("A2", "B1", "B2", "C1")[k]).otherwise(level)
    return one.select("user_id", F.round("ability", 6).alias("ability"), band.alias("band"), level.alias("level"))


def nearest_items(pool: DataFrame, target: float, most: int = 25) -> DataFrame:
    """The words whose rank is nearest to the target on a logarithmic scale."""
    distance = F.abs(F.log(F.greatest("rank", F.lit(1)).cast("double")) - F.log(F.lit(float(target))))
    return pool.withColumn("distance", F.round(distance, 9)).orderBy("distance", "rank").limit(most)


def distractors(pool: DataFrame, item_rank: int, most: int = 3) -> DataFrame:
    """The nearest words with glosses that differ from the item's and from each other."""
    gloss = F.lower(F.regexp_replace(F.trim("gloss"), r"\s+", ""))
    keyed = pool.withColumn("g", gloss)
    own = keyed.filter(F.col("rank") == item_rank).select(F.col("g").alias("own"))
    others = keyed.filter((F.col("rank") != item_rank) & (F.col("g") != "")).join(F.broadcast(own), F.col("g") == F.col("own"), "left_anti")
    distance = F.abs(F.col("rank") - item_rank)
    one = others.withColumn("distance", distance).withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("distance", "rank"))).filter("r = 1")
    return one.orderBy("distance", "rank").limit(most).drop("r", "g")


def hard_words(lexicon: DataFrame, known_rank: int = 3000, known_cefr: int = 2) -> DataFrame:
    """Adds steps (CEFR levels beyond the known one), hard (rarer or higher than known) and super_hard (two levels and more)."""
    steps = F.greatest(scoring.cefr_of(F.col("rank")) - known_cefr, F.lit(0))
    return lexicon.withColumns({"steps": steps, "hard": (steps > 0) | (F.col("rank") > known_rank), "super_hard": steps >= 2})


def hard_outside(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """term and hard for words outside the lexicon: seven letters and more, and no hyphenated compound of known words."""
    rows = terms.select("term").distinct()
    parts = rows.filter(F.col("term").contains("-")).select("term", F.explode(F.filter(F.split("term", "-"), lambda p: p != "")).alias("part"))
    known = parts.join(lexicon.select(F.col("term").alias("part"), F.lit(1).alias("k")), "part", "left").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("known"))
    joined = rows.join(known, "term", "left")
    transparent = F.coalesce((F.col("n") >= 2) & (F.col("n") == F.col("known")), F.lit(False))
    return joined.select("term", (~transparent & (F.char_length(F.regexp_replace("term", "[^A-Za-z]", "")) >= 7)).alias("hard"))


def is_initialism(raw: Column) -> Column:
    bare = F.regexp_replace(raw, "['’]s$", "")
    return (F.char_length(bare) >= 2) & bare.rlike(r"^[A-Z][A-Z0-9.\-&/]*$")


def is_honorific(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, r"\.$", "")).isin(*HONORIFICS)


def proper_nouns(texts: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """key, idx, word, initial, proper for the words of texts: a capital that neither begins a sentence nor a quotation, or an initialism."""
    pieces = F.regexp_extract_all(F.col(column), F.lit(r"[A-Za-z][A-Za-z'’-]*|[^A-Za-z]+"), F.lit(0))
    rows = texts.select(F.col(key).alias(key), pieces.alias("p")).select(key, F.explode(F.transform("p", lambda x, i: F.struct(i.alias("idx"), x.alias("word"), F.get(F.col("p"), i - 1).alias("gap"), F.get(F.col("p"), i - 2).alias("before")))).alias("x")).select(key, "x.*")
    words = rows.filter(F.col("word").rlike("^[A-Za-z]"))
    gap = F.regexp_replace(F.coalesce("gap", F.lit("")), r"\s+$", "")
    before = F.lower(F.coalesce("before", F.lit("")))
    abbreviated = (gap == ".") & (before.isin(*TITLE_ABBREVIATIONS) | (F.char_length(before) == 1))
    ends = gap.rlike("[.!?…。！？:;：；][\"'’”)\\]]*$") | gap.rlike("^[^\\p{L}\\p{N}]*[\"'“‘’«»(\\[{—–…][^\\p{L}\\p{N}]*$")
    initial = F.col("before").isNull() | (ends & ~abbreviated)
    word = F.col("word")
    proper = word.rlike("^[A-Z]") & ~is_honorific(word) & ~normal_key(word).isin(*CLOSED_CLASS) & (is_initialism(word) | ~initial)
    return words.select(key, "idx", "word", initial.alias("initial"), proper.alias("proper"))


def is_name_gloss(gloss: Column) -> Column:
    return F.coalesce(gloss.rlike("|".join(NAME_GLOSSES)), F.lit(False))


def name_gloss(gloss: Column) -> Column:
    """The gloss of a word used as a name: one that names, or the only sense; else null."""
    return F.when(is_name_gloss(gloss) | ~gloss.rlike("[，,；;、]"), gloss)


def honorific_gloss(gloss: Column) -> Column:
    """The first sense of a title's gloss; none for companies and offices."""
    return F.when(~gloss.rlike("公司|组织|局|部$"), F.get(F.split(gloss, "[，,；;、]"), F.lit(0)))


def phrase_keys(phrases: DataFrame, lexicon: DataFrame, phrase: str = "phrase") -> DataFrame:
    """phrase and lemma_key: each word by its base form in the lexicon; phrases of one word are out."""
    parts = F.filter(F.split(normal_key(F.col(phrase)), r"[\s-]+"), lambda p: p != "")
    rows = phrases.select(F.col(phrase).alias("phrase")).distinct().withColumn("parts", parts).filter(F.size("parts") >= 2)
    words = rows.select("phrase", F.posexplode("parts").alias("k", "word"))
    tried = words.select("word").distinct().select("word", F.posexplode(lemma_candidates(F.col("word"))).alias("place", "form"))
    base = tried.join(lexicon.select(F.col("term").alias("form")), "form").groupBy("word").agg(F.min_by("form", "place").alias("base"))
    keyed = words.join(base, "word", "left").withColumn("base", F.coalesce("base", "word"))
    return keyed.groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "base"))), lambda x: x["base"]), " ").alias("lemma_key"))


def chunk_lookup(selected: DataFrame, chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Selected phrases with the chunk of the same base forms; the first chunk by name if several share them."""
    known = phrase_keys(chunks, lexicon).groupBy("lemma_key").agg(F.min("phrase").alias("chunk"))
    return phrase_keys(selected.filter(F.trim("phrase").contains(" ")), lexicon).join(known, "lemma_key", "left").select("phrase", "lemma_key", "chunk")


def spaced_aliases(lexicon: DataFrame) -> DataFrame:
    """alias and term of hyphenated headwords that may be written with spaces: at least two open-class words, none ambiguous, none a headword itself."""
    keyed = phrase_keys(lexicon.filter(F.col("term").contains("-")).select(F.col("term").alias("phrase")), lexicon)
    parts = F.split("lemma_key", " ")
    open_words = F.size(F.filter(parts, lambda p: ~p.isin(*CLOSED_CLASS)))
    good = keyed.filter(~F.exists(parts, lambda p: F.char_length(p) < 2) & (open_words >= 2) & ~F.col("lemma_key").isin(*AMBIGUOUS_SPACED))
    return good.join(lexicon.select(F.col("term").alias("lemma_key")), "lemma_key", "left_anti").groupBy(F.col("lemma_key").alias("alias")).agg(F.min("phrase").alias("term"))


def decoded_details(rows: DataFrame, column: str = "row", *others: str) -> DataFrame:
    """The other columns, and word, senses, phonetic, pos, collins, oxford, rank, lemma, examples of positional arrays; an odd last example is dropped."""
    at = lambda k: F.get(column, F.lit(k))
    tail = F.slice(F.col(column), F.lit(9), F.greatest(F.size(column) - 8, F.lit(0)))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.size(tail) / 2).cast("int") - 1, F.lit(0))), lambda k: k * 2 + 1 < F.size(tail)), lambda k: F.struct(F.get(tail, k * 2).alias("en"), F.get(tail, k * 2 + 1).alias("zh")))
    return rows.filter(F.coalesce(F.trim(at(0)), F.lit("")) != "").select(
        *others, F.trim(at(0)).alias("word"), F.filter(F.split(F.coalesce(at(1), F.lit("")), "\n"), lambda s: F.trim(s) != "").alias("senses"), F.nullif(at(2), F.lit("")).alias("phonetic"), F.nullif(at(3), F.lit("")).alias("pos"),
        F.coalesce(at(4).try_cast("int"), F.lit(0)).alias("collins"), F.coalesce(at(5).try_cast("int") == 1, F.lit(False)).alias("oxford"), at(6).try_cast("int").alias("rank"), F.nullif(at(7), F.lit("")).alias("lemma"), pairs.alias("examples"),
    )


def wants_gloss(show: Column, gloss: Column, chunk: Column, proper: Column, hard: Column, super_hard: Column) -> Column:
    """Whether a span shows its gloss: chunks and names always, words if they are far beyond what is known."""
    return show & (F.coalesce(gloss, F.lit("")) != "") & (chunk | proper | (super_hard & hard))
