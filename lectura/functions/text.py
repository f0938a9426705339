"""Text expressions: counting, tokens, URLs, hashes, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
#: Query parameters that only track visitors.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "twclid", "igshid",
    "ref", "ref_src", "ref_url", "mc_cid", "mc_eid", "yclid", "_hsenc", "_hsmi", "vero_id", "pk_campaign", "pk_kwd", "si",
)
#: Words of headlines that carry no topic.
STOPWORDS = (
    "the a an and or of to in on for with as at by from is are was were be been it its that this these those will would could should has have had not but "
    "they their them he she we you s t say says said new over after before more most than into out up all also just like get amid among between while without what when how why who"
).split()
EXCERPT_CHARS = 6000
# ----------------------------------------------------------------------------------------------------------------

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def words(text: Column) -> Column:
    """array<string> of what stands between white space of any script; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def excerpt(text: Column) -> Column:
    return F.substring(text, 1, EXCERPT_CHARS)


def clip(text: Column, chars: int) -> Column:
    """The first code points, trimmed of white space."""
    return F.regexp_replace(F.left(text, F.lit(chars)), r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def contains_folded(text: Column, needle: str) -> Column:
    """Case-blind literal substring test; the needle has no wildcards."""
    return F.lower(text).contains(needle.lower())


def title_tokens(title: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def content_terms(text: Column) -> Column:
    """Distinct lower-case tokens of two characters and more that are neither numbers nor stop words."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    kept = F.filter(tokens, lambda t: (F.char_length(t) >= 2) & ~t.rlike("^[0-9]+$"))
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, STOPWORDS)))


def difficulty_tokens(text: Column) -> Column:
    """Lower-case English words (inner apostrophes and hyphens kept) of two characters and more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z'-]*)"), F.lit(1)), lambda t: F.char_length(t) >= 2)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def canonical_url(url: Column) -> Column:
    """http(s) urls without fragment, tracking parameters and closing slashes, scheme and host in lower case; others as they are."""
    head = F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING_PARAMS))
    kept = F.array_join(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    trimmed = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    made = F.concat(F.lower(head), F.when(trimmed == "", "/").otherwise(trimmed), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(head != "", made).otherwise(url)


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as struct<hi, lo> of two 32-bit halves; 64-bit products never overflow a long that way."""
    digits = F.hex(F.encode(text, "UTF-8"))
    octets = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    pair = lambda hi, lo: F.struct(hi.alias("hi"), lo.alias("lo"))

    def step(h: Column, octet: Column) -> Column:
        low = h["lo"].bitwiseXOR(octet)
        product = low * 0x1B3
        high = h["hi"] * 0x1B3 + F.shiftright(product, 32) + low * 256
        return pair(high.bitwiseAND(mask), product.bitwiseAND(mask))

    return F.aggregate(octets, pair(F.lit(0xCBF29CE4).cast("long"), F.lit(0x84222325).cast("long")), step)


def fnv1a64_hex(text: Column) -> Column:
    h = fnv1a64(text)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def slug(text: Column) -> Column:
    """ASCII id: lower-cased, separators become `-`, other characters `u` and their code in hex, at most 48 characters."""
    letters = F.split(ascii_lower(F.trim(text)), "")
    spelled = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.when(c.rlike("[a-z0-9]"), c).when(c.rlike(r"(?U)[\s_-]"), "-").otherwise(F.concat(F.lit("u"), F.lower(F.hex(F.ascii(c))))))
    joined = F.regexp_replace(F.array_join(spelled, ""), "-+", "-")
    return F.left(F.regexp_replace(joined, "^-+|-+$", ""), F.lit(48))


def html_to_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles or comments, line breaks at block elements, entities decoded."""
    rules = (
        (r"(?is)<!--.*?-->|<(script|style|head|template|noscript)\b.*?</\1\s*>|\s+", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</?(p|div|article|section|header|footer|nav|main|aside|ul|ol|table|tr|h[1-6]|blockquote|pre|figure)\b[^>]*>", "\n\n"),
        (r"(?i)<li\b[^>]*>", "\n* "), (r"<[^>]+>", ""), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;|&apos;", "'"), (r"&amp;", "&"),
        (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
    )
    # folded over an array of rules: one regular expression in the generated code instead of one for each rule
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules))
    return F.aggregate(pairs, F.coalesce(html, F.lit("")), lambda s, r: F.regexp_replace(s, r["a"], r["b"]))


def title_from_html(html: Column) -> Column:
    """The <title>'s first line without a site name behind ` | `, an em, en or plain dash, if at least 8 characters stay; null without a title."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    line = F.trim(F.element_at(F.split(F.trim(raw), "\n"), 1))
    marks = F.array(*map(F.lit, (" | ", " — ", " – ", " - ")))

    def cut(title: Column, mark: Column) -> Column:
        left = F.trim(F.split_part(title, mark, F.lit(1)))
        return F.when(title.contains(mark) & (F.char_length(left) >= 8), left).otherwise(title)

    best = F.aggregate(marks, line, cut)
    return F.when(line != "", best)


def strip_fences(text: Column) -> Column:
    """Without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def context_around(text: Column, term: Column, reach: int = 60, most: int = 140) -> Column:
    """The surroundings of a term's first mention, cut to `most` characters at a sentence end if there is one; "" if it isn't there."""
    at = F.locate_column(text, term) if hasattr(F, "locate_column") else F.position(F.lower(term), F.lower(text))
    begin = F.greatest(at - reach, F.lit(1))
    piece = F.trim(F.regexp_replace(F.substring(text, begin, at - begin + F.char_length(term) + reach), r"\s+", " "))
    head = F.left(piece, F.lit(most))
    last = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(at == 0, "").when(F.char_length(piece) <= most, piece).otherwise(F.when(F.char_length(last) >= 40, last).otherwise(head))


def looks_like_markdown(url: Column, text: Column) -> Column:
    """A Markdown file by its url, a code fence, two headings, or two kinds of markup."""
    kinds = [r"(?m)^#{1,6}\s+\S", r"(?m)^\s*[-*+]\s+\S", r"(?m)^\s*\d+\.\s+\S", r"\[[^\]]+\]\([^)]+\)", r"(?m)^>\s+\S", r"\*\*[^*]+\*\*"]
    score = sum((text.rlike(k).cast("int") for k in kinds[1:]), text.rlike(kinds[0]).cast("int"))
    return F.coalesce(url, F.lit("")).rlike(r"(?i)\.(md|markdown|mdx)([?#]|$)") | text.contains("```") | (F.regexp_count(text, F.lit(kinds[0])) >= 2) | (score >= 2)


def format_minutes(minutes: Column) -> Column:
    """Minutes below an hour, else hours and what is left."""
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" 小时"))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" 分钟"))).when(minutes % 60 == 0, hours).otherwise(F.concat(hours, F.lit(" "), (minutes % 60).cast("string"), F.lit(" 分")))


def format_thousands(count: Column) -> Column:
    return F.when(count < 1000, count.cast("string")).otherwise(F.concat(F.format_number(count / 1000.0, 1), F.lit("k")))


def part_of_speech(labels: Column) -> Column:
    """`n/v.` style labels joined by a middle dot."""
    return F.array_join(F.filter(F.transform(F.split(labels, "/"), lambda t: F.trim(t)), lambda p: p != ""), " · ")


def blocked_host(host: Column) -> Column:
    """True for host names and IPv4 addresses that don't belong to the public internet; name resolution isn't done."""
    octet = [F.try_element_at(F.split(host, r"\."), F.lit(k)).try_cast("int") for k in range(1, 5)]
    a, b, _, _ = octet
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    private = (a.isin(0, 10, 127)) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.between(18, 19))
    return (host == "") | (F.lower(host) == "localhost") | F.lower(host).endswith(".localhost") | F.lower(host).endswith(".local") | (ip & private)


def chat_url(base: Column) -> Column:
    """The endpoint of a chat service from its base address."""
    root = F.regexp_replace(F.trim(base), "/+$", "")
    known = root.endswith("api.deepseek.com") | root.endswith("api.openai.com")
    return F.when(root.endswith("/chat/completions"), root).when(known, F.concat(root, F.lit("/v1/chat/completions"))).otherwise(F.concat(root, F.lit("/chat/completions")))


def is_all_caps(text: Column, least: int = 2) -> Column:
    """An initialism or a word in capitals, with or without a possessive ending."""
    bare = F.regexp_replace(F.trim(text), "['’]s$", "")
    return (F.char_length(bare) >= least) & bare.rlike(r"^[A-Z][A-Z0-9.\-&/]*$")


def is_phrase_selection(text: Column, most: int = 6) -> Column:
    """Two to `most` English words, not a sentence."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return one.rlike(rf"^[A-Za-z][A-Za-z'’-]*(?: [A-Za-z][A-Za-z'’-]*){{1,{most - 1}}}$")


def stable_json(pairs: Column) -> Column:
    """A map as JSON with its keys in order; the same map always gives the same text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def insight(today: Column, week: Column, total: Column, new_words: Column) -> Column:
    """One line of learning statistics; new words only if there are any."""
    text = lambda label, n: F.concat(F.lit(label + " "), n.cast("string"))
    return F.concat_ws(" · ", text("今日", today), text("本周", week), text("总", total), F.when(new_words > 0, text("本周新词", new_words)))
