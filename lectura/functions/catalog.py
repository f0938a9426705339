"""Expressions over a book catalog and article lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_spaces


def shelf(bookshelves: Column) -> Column:
    """The first `Category: X` of a `;` list, else its first part that isn't empty, else ""."""
    parts = F.filter(F.transform(F.split(F.coalesce(bookshelves, F.lit("")), ";"), lambda t: F.trim(t)), lambda p: p != "")
    named = F.filter(parts, lambda p: p.startswith("Category: "))
    return F.coalesce(F.trim(F.substr(F.get(named, F.lit(0)), F.lit(11))), F.get(parts, F.lit(0)), F.lit(""))


def display_author(authors: Column) -> Column:
    """The first author as `given family`, without years; other shapes as published."""
    first = F.trim(F.substring_index(F.coalesce(authors, F.lit("")), ";", 1))
    parts = F.filter(F.transform(F.split(first, ","), lambda t: F.trim(t)), lambda p: p != "")
    dated = (F.size(parts) >= 2) & F.element_at(parts, -1).rlike("[0-9]")
    named = F.when(dated, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(named) == 2, F.concat(F.get(named, F.lit(1)), F.lit(" "), F.get(named, F.lit(0)))).when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise(first)


def description(author: Column, issued: Column) -> Column:
    year = F.trim(F.left(F.coalesce(issued, F.lit("")), F.lit(4)))
    return F.concat_ws(" · ", F.nullif(author, F.lit("")), F.nullif(year, F.lit("")))


def accepted(gid: Column, kind: Column, language: Column, title: Column) -> Column:
    """A catalog row with a numeric id, of type Text, with English among its languages, and a title."""
    english = F.exists(F.split(language, ";"), lambda x: F.lower(F.trim(x)) == "en")
    return F.coalesce(F.trim(gid).try_cast("long").isNotNull() & (F.lower(F.trim(kind)) == "text") & english & (collapse_spaces(title) != ""), F.lit(False))


def gid_of(url: Column) -> Column:
    """The number at a url's end, null if there is none."""
    return F.regexp_extract(url, "/([0-9]+)/?$", 1).try_cast("long")


def length_band(words: Column) -> Column:
    """Reading length as six bands, "" if unknown."""
    return F.when(F.coalesce(words, F.lit(0)) <= 0, "").when(words < 600, "很短").when(words < 900, "短").when(words < 1200, "中").when(words < 1800, "长").when(words < 3000, "很长").otherwise("极长")
