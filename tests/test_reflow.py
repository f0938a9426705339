"""The patterns of reflow against rules applied sign by sign."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lectura.functions import prose, reflow

CLOSERS = "\"'”’)]）"
PARTS = ["Mr", "e.g", "U.S", "A", "B.C", "end", "Word", "über", "Ärger", "3", "14", "com", "example", "well", "mid", "self", "x", ".", ".", ".", "..", "!", "?", ",", ";", ":", " ", " ", " ", "\n", "\n", "\n\n", "-", "-\n", "—", "--", "“", "”", "'", "(", ")", "- item", "2) ", "…", "[Pg 3]", "***", "\t", "\u00a0"]


def ends_at(t: str, i: int) -> bool:
    if t[i] in "!?":
        return True
    if t[i] != "." or t[i + 1 : i + 2] == ".":
        return False
    digit = lambda c: len(c) == 1 and c in "0123456789"
    if digit(t[i - 1 : i]) and digit(t[i + 1 : i + 2]):
        return False
    j = i
    while j and (t[j - 1].isalnum() or t[j - 1] == "."):
        j -= 1
    word, k = t[j:i], i + 1
    while k < len(t) and t[k].isascii() and t[k].isalpha():
        k += 1
    behind = t[i + 1 : k]
    if behind and (t[k : k + 1] == "." or (word and behind.lower() in prose.SUFFIXES)):
        return False
    capitals = word and all(c == "." or "A" <= c <= "Z" for c in word)
    return not (word.lower() in prose.ABBREVIATIONS or (capitals and (len(word) == 1 or "." in word)))


def spaced(t):
    out = ""
    for i, c in enumerate(t):
        following = t[i + 1 : i + 2]
        out += c + (" " if (c in ".!?" and following.isalnum() and ends_at(t, i)) or (c in ",;:" and following.isalpha()) else "")
    return out


def paragraphs(t):
    out = []
    for line in (x.strip(" \t\n\r\f") for x in t.split("\n")):
        if not line:
            continue
        last = out[-1].rstrip(CLOSERS) if out else ""
        item = re.match(r"[-*•·–](?=[ \t]|$)|[0-9]+[.)][ \t]", line)
        begins = line[0].isupper() or line[0] in "0123456789\"'“‘(["
        if not out or item or (begins and last and ends_at(out[-1] + "\n", len(last) - 1)):
            out.append(line)
        else:
            out[-1] += " " + line
    return out


def groups(t):
    if len(t) <= prose.LONG_BLOCK:
        return [t]
    out, begin, weight, i = [], 0, 0, 0
    while i < len(t):
        if t[i] in ".!?" and ends_at(t, i):
            while t[i + 1 : i + 2] and t[i + 1] in CLOSERS:
                i += 1
            weight += i + 1 - begin
            if weight >= prose.GROUP:
                out.append(t[begin : i + 1].strip())
                begin, weight = i + 1, 0
        i += 1
    rest = t[begin:].strip()
    if rest and out and len(rest) < prose.GROUP // 2:
        out[-1] += " " + rest
    elif rest:
        out.append(rest)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["", " ", ".", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(400))]


def each(spark, texts, expression):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(4)
    return [r["x"] for r in sorted(frame.select("n", expression(F.col("t")).alias("x")).collect(), key=lambda r: r["n"])]


def test_sentence_ends(spark, texts):
    assert each(spark, texts, reflow.sentence_ends) == [sum(ends_at(t, i) for i, c in enumerate(t) if c in ".!?") for t in texts]


def test_spaces(spark, texts):
    assert each(spark, texts, reflow.add_spaces) == [spaced(t) for t in texts]


def test_paragraphs_of_a_block(spark, texts):
    plain = [t.replace("\u00a0", " ") for t in texts]
    assert each(spark, plain, reflow.split_block) == [paragraphs(t) for t in plain]


def test_long_paragraphs(spark):
    rng = random.Random(12)
    parts = [p for p in PARTS if "\n" not in p] + ["some longer words here "] * 12
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50, 400))) for _ in range(60)]
    assert [[p.strip() for p in g] for g in each(spark, texts, reflow.split_long)] == [[p.strip() for p in groups(t)] for t in texts]


def test_hyphens(spark):
    cases = {"exam-\nple": "example", "Well-\n known": "Well-known", "state-of-the-\nart": "state-of-the-art", "co-\nOp": "co-\nOp", "a1-\nb": "a1-\nb", "x- \t\n  y": "xy", "no break": "no break", "-\nz": "-\nz"}
    assert each(spark, list(cases), reflow.rejoin_hyphens) == list(cases.values())


def test_links(spark):
    cases = {
        "see [label](http://x.y/z(1)) ok": "see label ok", "at https://example.com/a.": "at.", "(https://e.com/a_(b))": "", "<mailto:a@b.c>, then": ", then", "go www.x.org/?q=1; now": "go; now",
        "![alt](u.png) it": "alt it", "[a](b) [c](d)": "a c", "none: here": "none: here", "ftp://x y": " y",
    }
    assert each(spark, list(cases), reflow.strip_links) == list(cases.values())


def test_normal_paragraphs(spark):
    cases = {"a  --  b": "a—b", "wait . . . ok": "wait … ok", "“ Hi ” he said ,then": '"Hi" he said, then', "a\u00adb\x07c": "abc", "one　two three": "one two three", "x ( y ) z": "x (y) z", "‘q’": "'q'", " \t ": ""}
    assert each(spark, list(cases), reflow.normal_paragraph) == list(cases.values())


def test_nothing(spark):
    frame = spark.createDataFrame([(None,), ("",), ("\n\n \n",)], "t string")
    assert [r[0] for r in frame.select(reflow.reflow_column("t")).collect()] == [[], [], []]
    assert [r[0] for r in frame.select(reflow.chapters_column("t")).collect()] == [[], [], []]
