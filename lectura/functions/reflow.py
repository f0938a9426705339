"""Bodies as clean paragraphs: expressions over whole texts, cut and joined by patterns.

Where a sentence ends is one pattern; line breaks, missing spaces and long paragraphs all use it. Paragraphs stay in an
array of their row until the end, so nothing is shuffled. Only the removal of link definitions and page furniture, which
looks things up within a text, is a kernel of `prose`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import prose

# --- fixed values -----------------------------------------------------------------------------------------------------
CLOSERS = "\"'”’)\\]）"
STARTERS = "\\p{Lu}0-9\"'“‘(\\["
INVISIBLE = "\u00ad\ufeff\u200b\u200c\u200d\u2060" + "".join(map(chr, [*range(9), 11, 12, *range(14, 32), *range(127, 160)]))
SPACES = "\t\n\r\u00a0\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛", "“”„‟"
ITEM = r"(?:[-*•·–](?:\s|$)|[0-9]+[.)][^\S\n])"
BOOK_BEGIN, BOOK_END = r"(?im)^\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG.*$", r"(?im)^\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG.*$"
PAGE_MARK, RULE = r"\[(?:pg|page|illustration|figure|image)[^\]\n]*\]", r"[*=_~-]{3,}"
# ----------------------------------------------------------------------------------------------------------------------
_ALNUM = r"[\p{L}\p{N}.]"
_SHORT = "|".join(sorted(x.replace(".", r"\.") for x in prose.ABBREVIATIONS))
_SUFFIX = "|".join(sorted(prose.SUFFIXES))
#: A sign that ends a sentence: no decimal point, dot of a run, initial, abbreviation, acronym, or dot of a name.
SENTENCE_END = (
    rf"(?:[!?]|\.(?![.])(?<!(?<!{_ALNUM})(?i:{_SHORT})\.)(?<!(?<!{_ALNUM})[A-Z]\.)(?<!(?<!{_ALNUM})[A-Z.]{{0,12}}\.[A-Z.]{{0,12}}\.)"
    rf"(?!(?<=[0-9]\.)[0-9])(?![A-Za-z]{{1,64}}\.)(?!(?<={_ALNUM}\.)(?i:{_SUFFIX})(?![A-Za-z])))"
)
_CUT = "\x01"


def _cuts(text: Column) -> Column:
    return F.split(text, _CUT)


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\r\f"))


def _where(text: Column, marks: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """The text, changed if it holds one of the marks: most texts needn't be searched for patterns at all."""

    def changed(t: Column) -> Column:
        found = t.contains(marks[0])
        for mark in marks[1:]:
            found = found | t.contains(mark)
        return F.when(found, change(t)).otherwise(t)

    return F.get(F.transform(F.array(text), changed), F.lit(0))


def sentence_ends(text: Column) -> Column:
    """How many signs end a sentence."""
    return F.regexp_count(text, F.lit(SENTENCE_END))


def strip_links(text: Column) -> Column:
    """Links give way to their words, bare addresses go; the sentence's signs behind them stay."""
    inside = r"(?:[^\s<>()\[\]{}]|\([^\s<>()]*\)|\[[^\s<>\[\]]*\]|\{[^\s<>{}]*\}|[(\[{])"
    address = rf"(?i)<?(?:https?://|ftp://|mailto:|www\.){inside}*?(?=[.,;:!?'\"’”*_~]*(?:[\s<>)\]}}]|$))>?"
    words = _where(text, ("](",), lambda t: F.regexp_replace(t, r"!?\[([^\]]*)\]\((?:[^()\s]|\([^()]*\))*\)", "$1"))
    bare = _where(words, ("://", ":", "www.", "WWW.", "Www."), lambda t: F.regexp_replace(t, address, ""))
    none = F.regexp_replace(bare, r"[(\[{][ \t]*[)\]}]", "")
    return F.regexp_replace(F.regexp_replace(none, r"(?<=[(\[{])[ \t]+(?=[)\]}])|[ \t]+(?=[,.;:!?%)\]}”’）])", ""), r"[ \t]{2,}", " ")


def rejoin_hyphens(text: Column) -> Column:
    """Words that a line's end divided, whole again; compounds keep their hyphen."""
    heads = "|".join(sorted(prose.COMPOUND_HEADS))
    kept = rf"((?<=[A-Za-z]-)[A-Za-z]+|(?<![A-Za-z])(?i:{heads}))-[ \t]*\n[ \t]*(?=[a-z])"
    whole = lambda t: F.regexp_replace(F.regexp_replace(t, kept, "$1-"), r"(?<=[A-Za-z])-[ \t]*\n[ \t]*(?=[a-z])", "")
    return _where(text, ("-\n", "- ", "-\t"), whole)


def add_spaces(text: Column) -> Column:
    """A space behind punctuation that a letter follows (or a digit, behind a sentence)."""
    return F.regexp_replace(text, rf"({SENTENCE_END}(?=[\p{{L}}\p{{N}}])|[,;:](?=\p{{L}}))", "$1 ")


def normal_paragraph(text: Column) -> Column:
    """Plain spaces and quotes, dashes and ellipses as one sign, spaces only where they belong."""
    plain = F.translate(text, SPACES + INVISIBLE, " " * len(SPACES))
    dots = _where(plain, ("..", ". ."), lambda t: F.regexp_replace(t, r"\. *\. *\.", "…"))
    signs = _where(dots, ("--", "—"), lambda t: F.regexp_replace(t, r" *(?:--|—) *", "—"))
    close = F.regexp_replace(signs, r"(?<=[“‘(]) +| +(?=[,.;:!?%)\]}”’）])", "")
    quoted = F.translate(close, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return F.trim(add_spaces(F.regexp_replace(quoted, " {2,}", " ")))


def split_block(block: Column) -> Column:
    """The paragraphs of one block: a line break counts in front of an item, or between sentences that look like it."""
    lines = F.regexp_replace(_strip(block), r"[^\S\n]*\n\s*", "\n")
    items = F.regexp_replace(lines, rf"\n(?={ITEM})", _CUT)
    marked = F.regexp_replace(items, rf"({SENTENCE_END}[{CLOSERS}]*)\n(?=[{STARTERS}])", rf"$1{_CUT}")
    return F.filter(_cuts(F.translate(marked, "\n", " ")), lambda p: p != "")


def split_long(paragraph: Column) -> Column:
    """A long paragraph in groups of sentences; a short rest joins the last.

    A group is closed when the distances of its sentences' ends from its beginning add up to `GROUP`.
    """
    sentences = F.filter(_cuts(F.regexp_replace(paragraph, rf"({SENTENCE_END}[{CLOSERS}]*)", rf"$1{_CUT}")), lambda s: s != "")
    state = lambda done, open_, weight: F.struct(done.alias("done"), open_.alias("open"), weight.alias("weight"))

    def step(s: Column, sentence: Column) -> Column:
        grown = F.concat(s["open"], sentence)
        weight = s["weight"] + F.char_length(grown)
        ends = sentence.rlike(rf"{SENTENCE_END}[{CLOSERS}]*$")
        return F.when(ends & (weight >= prose.GROUP), state(F.array_append(s["done"], _strip(grown)), F.lit(""), F.lit(0))).otherwise(state(s["done"], grown, weight))

    def closed(s: Column) -> Column:
        rest = _strip(s["open"])
        short = (F.char_length(rest) < prose.GROUP // 2) & (F.size(s["done"]) > 0)
        joined = F.concat(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), F.array(F.concat_ws(" ", F.get(s["done"], F.size(s["done"]) - 1), rest)))
        return F.when(rest == "", s["done"]).when(short, joined).otherwise(F.array_append(s["done"], rest))

    groups = F.aggregate(sentences, state(F.array().cast("array<string>"), F.lit(""), F.lit(0)), step, closed)
    return F.when(F.char_length(paragraph) <= prose.LONG_BLOCK, F.array(paragraph)).otherwise(groups)


def reflow_column(text: Column | str) -> Column:
    """A body as an array of clean paragraphs; null gives none."""
    body = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\r\n?", "\n")
    clean = rejoin_hyphens(strip_links(prose.clean_body_column(body)))
    blocks = F.split(clean, r"\n[ \t]*\n+")
    paragraphs = F.filter(F.transform(F.flatten(F.transform(blocks, split_block)), normal_paragraph), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, split_long))


# --- books ------------------------------------------------------------------------------------------------------------


def book_body(raw: Column) -> Column:
    """What stands between a book file's begin and end marks; all of it without marks."""
    behind = F.element_at(F.split(raw, BOOK_BEGIN, 2), -1)
    return F.trim(F.element_at(F.split(behind, BOOK_END, 2), 1), F.lit("\r\n"))


def book_blocks(raw: Column) -> Column:
    """A book's paragraphs with their line wraps undone, without page marks and rules."""
    lines = F.concat(F.regexp_replace(book_body(raw), r"\r\n?", "\n"), F.lit("\n"))
    kept = F.regexp_replace(lines, rf"(?im)^[^\S\n]*(?:{PAGE_MARK}|{RULE})[^\S\n]*\n", "")
    whole = lambda b: F.trim(F.regexp_replace(F.regexp_replace(_strip(b), r"(?<!-)-[^\S\n]*\n[^\S\n]*(?=\p{Ll})", ""), r"\s*\n\s*", " "))
    return F.filter(F.transform(F.split(kept, r"\n(?:[^\S\n]*\n)+"), whole), lambda b: b != "")


def chapters_column(raw: Column | str) -> Column:
    """array<struct<title, text>> of a book's chapters."""
    return prose.chapters_of(book_blocks(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))))
