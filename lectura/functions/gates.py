"""Quality gates of feed entries: what is wrong with a body, and what to do with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, word_count, words

# --- fixed values -----------------------------------------------------------------------------------------------
TRUNCATION_MARKERS = ("continue reading", "read more", "read the rest", "read the full", "view the full", "full story at", "[…]", "…]")
PAYWALL_MARKERS = ("subscribe to continue", "subscription required", "create a free account to read", "sign in to read", "already a subscriber", "metered paywall", "for subscribers only")
CHROME_MARKERS = ("skip to main content", "skip to content", "open navigation menu", "googletagmanager.com")
LEAST_WORDS, SHELL_CHARS, TRUST_CHARS = 400, 200, 2000
ROUNDUP = r"(?i)\b(roundup|weekly review|weekly links|daily digest|daily briefing|link roundup|link dump)\b"
TRANSCRIPT = r"(?i)\b(transcript|podcast|episode)\b"
TIMESTAMP = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
KEYWORD_TAIL = r"(?is)(?:Keywords for this article|Filed under:|^\s*Tags:).*$"
FOOTNOTE_LINE, TAG = r"(?m)^\[\d+\]:\s+\S+\s*$", r"<[^>]+>"
LINK_ITEM = r"^\s*(?:[-*]|\d+\.)\s+\["
# ----------------------------------------------------------------------------------------------------------------


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def looks_truncated(text: Column) -> Column:
    return _any(ascii_lower(F.right(text, F.lit(100))), TRUNCATION_MARKERS)


def looks_like_chrome(text: Column) -> Column:
    return _any(ascii_lower(F.left(text, F.lit(480))), CHROME_MARKERS)


def looks_like_paywall(text: Column) -> Column:
    return _any(ascii_lower(text), PAYWALL_MARKERS)


def trust_chars(ratio: Column) -> Column:
    """Characters from which a feed's own body is trusted, by the share of its full texts (negative: unknown)."""
    return F.when(ratio >= 0.7, 1200).when((ratio >= 0) & (ratio <= 0.2), 3200).otherwise(TRUST_CHARS)


def prose_chars(text: Column) -> Column:
    """Characters without white space, keyword tails, footnote definitions and tags."""
    out = F.regexp_replace(text, KEYWORD_TAIL, "")
    out = F.regexp_replace(out, FOOTNOTE_LINE, "")
    return F.char_length(F.array_join(words(F.regexp_replace(out, TAG, " ")), ""))


def is_link_dump(text: Column) -> Column:
    """At least 8 lines with text, half of which are list items that begin with a link."""
    lines = F.filter(F.split(F.regexp_replace(text, FOOTNOTE_LINE, ""), "\n"), lambda x: F.trim(x) != "")
    links = F.size(F.filter(lines, lambda x: x.rlike(LINK_ITEM)))
    return (F.size(lines) >= 8) & (links * 2 >= F.size(lines))


def body_defect(text: Column) -> Column:
    """shell, nav_or_links, truncated, or null."""
    return F.when(prose_chars(text) < SHELL_CHARS, "shell").when(looks_like_chrome(text) | is_link_dump(text), "nav_or_links").when(looks_truncated(text), "truncated")


def reject_reason(text: Column) -> Column:
    """A defect, too_short, or null for a body that can be read."""
    return F.coalesce(body_defect(text), F.when(word_count(text) < LEAST_WORDS, "too_short"))


def is_full_text(text: Column, bar: Column) -> Column:
    return (F.char_length(text) >= bar) & reject_reason(text).isNull()


def link_density(text: Column) -> Column:
    """Bare links to a thousand words."""
    return F.regexp_count(text, F.lit("https?://")) / F.greatest(word_count(text), F.lit(1)) * 1000


def is_roundup(title: Column, text: Column) -> Column:
    return title.rlike(ROUNDUP) | (link_density(text) > 80)


def is_transcript(title: Column, text: Column) -> Column:
    return title.rlike(TRANSCRIPT) | (F.regexp_count(text, F.lit(TIMESTAMP)) >= 20)


def is_blocked(title: Column, text: Column) -> Column:
    return is_roundup(title, text) | is_transcript(title, text)


def is_english_tag(tag: Column) -> Column:
    return F.lower(F.trim(tag)).rlike("^en($|[-_])")


def looks_english(title: Column, text: Column) -> Column:
    """By script: few letters pass; else at most 12 % outside A-Z."""
    sample = F.concat(title, F.lit(" "), F.left(text, F.lit(1200)))
    letters, latin = F.regexp_count(sample, F.lit(r"\p{IsAlphabetic}")), F.regexp_count(sample, F.lit("[A-Za-z]"))
    return (letters < 40) | (((letters - latin) / letters <= 0.12) & (latin / letters >= 0.85))


def is_english(tag: Column, title: Column, text: Column) -> Column:
    """A tag, if there is one, must be English, and the script too."""
    return F.coalesce(is_english_tag(tag), F.lit(True)) & looks_english(title, text)


def choose_body(own: Column, page: Column) -> Column:
    """The page's text if it can be read, else the entry's own if that can, else null."""
    return F.when(page.isNotNull() & reject_reason(page).isNull(), page).when(reject_reason(own).isNull(), own)


def cannot_beat(raw_bytes: Column, stored_chars: Column) -> Column:
    """True if a raw body is too small for its text to be longer than the stored one."""
    return raw_bytes + F.floor(raw_bytes / 16) + 1024 <= stored_chars
