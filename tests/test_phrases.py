"""Spans of phrases and words against a scan of each text."""

from __future__ import annotations

import random
import re

import pytest

from lectura.operators import phrases

WORD = re.compile(phrases.WORD)


def scanned(text: str, ranks: dict[str, int], known: set[str]) -> list[tuple]:
    """One pass from left to right: the longest phrase, else a known word, else text."""
    words = list(WORD.finditer(text))
    spans, at, i = [], 0, 0
    key = lambda w: w[0].lower().replace("’", "'")
    while i < len(words):
        n, run = 0, [key(words[i])]
        for j in range(i, min(i + phrases.LONGEST, len(words))):
            if j > i:
                if not re.fullmatch(r"[ \t\n\x0b\f\r]+", text[words[j - 1].end() : words[j].start()]):
                    break
                run.append(key(words[j]))
            n = j - i + 1 if " ".join(run) in known else n
        kind = "phrase" if n else "word" if run[0] in ranks else None
        if kind:
            a, b = words[i].start(), words[i + max(n, 1) - 1].end()
            spans += [("text", text[at:a], None, None)] * (a > at) + [(kind, text[a:b], " ".join(run[:n]) if n else run[0], None if n else ranks[run[0]])]
            at = b
        i += max(n, 1)
    return spans + [("text", text[at:], None, None)] * (at < len(text))


def got(spark, texts, ranks, known):
    frame = spark.createDataFrame(texts, "id string, text string").repartition(3)
    lexicon = spark.createDataFrame(list(ranks.items()), "term string, rank int")
    rows = phrases.annotate(frame, lexicon, spark.createDataFrame([(k,) for k in known], "key string")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["idx"])):
        found.setdefault(r["id"], []).append((r["type"], r["text"], r["key"], r["rank"]))
        assert r["idx"] == len(found[r["id"]]) - 1
    return found


def test_against_a_scan(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "c", "dog", "Dog’s", "x-y"]
    gaps = [" ", " ", " ", "  ", "\n", ", ", "-, ", " — ", "1"]
    texts = [(str(k), rng.choice(["", " ", "("]) + "".join(rng.choice(alphabet) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for k in range(60)]
    known = {" ".join(rng.choice(["a", "b", "c", "dog", "dog's"]) for _ in range(rng.choice([1, 2, 2, 3, 4, 6]))) for _ in range(60)}
    ranks = {"a": 1, "dog": 7, "x-y": 9}
    found = got(spark, texts, ranks, known | {"a " * 6 + "a", ""})
    for name, text in texts:
        assert found.get(name, []) == scanned(text, ranks, known)
        assert "".join(s[1] for s in found.get(name, [])) == text


def test_longest_phrase_first(spark):
    found = got(spark, [("1", "We're looking  forward to it, looking forward."), ("2", "LOOKING FORWARD TO"), ("3", ""), ("4", None), (None, "it")], {"it": 2}, {"looking forward to", "forward to", "looking forward"})
    assert [s[:3] for s in found["1"]] == [("text", "We're ", None), ("phrase", "looking  forward to", "looking forward to"), ("text", " ", None), ("word", "it", "it"), ("text", ", ", None), ("phrase", "looking forward", "looking forward"), ("text", ".", None)]
    assert found["2"] == [("phrase", "LOOKING FORWARD TO", "looking forward to", None)] and set(found) == {"1", "2"}


def test_without_phrases_or_words(spark):
    assert got(spark, [("1", "a b")], {}, set()) == {"1": [("text", "a b", None, None)]}


def test_a_long_text(spark):
    text = "the cat sat on the mat and " * 3000
    found = got(spark, [("1", text)], {"cat": 1, "mat": 2}, {"the cat", "cat sat", "sat on the"})
    assert found["1"] == scanned(text, {"cat": 1, "mat": 2}, {"the cat", "cat sat", "sat on the"})


@pytest.mark.parametrize("frequent, marks, sent", [(200_000, 1000, 1 << 20), (1, 1000, 1), (1, 0, 1), (0, 0, 1 << 20)])
def test_what_is_sent_changes_nothing(spark, monkeypatch, frequent, marks, sent):
    for name, value in (("FREQUENT", frequent), ("MARKS", marks), ("BROADCAST_BYTES", sent)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(7)
    alphabet = ["a", "B", "c", "dog", "Dog’s", "x-y", "Ka", "İb", "é", "été", "’a"]
    gaps = [" ", " ", " ", "  ", "\t", "\x0b\n", "\xa0", "  ", ", ", "-, ", "’", "1", ""]
    texts = [(str(k), "".join(rng.choice(alphabet) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for k in range(60)]
    known = {" ".join(rng.choice(["a", "b", "c", "dog", "dog's", "x-y"]) for _ in range(rng.choice([1, 2, 2, 3, 4, 5, 6]))) for _ in range(60)}
    ranks = {"a": 1, "dog": 2, "x-y": 3, "dog's": 3, "ka": 4, "ib": 5}
    found = got(spark, texts, ranks, known)
    for name, text in texts:
        assert found.get(name, []) == scanned(text, ranks, known)


def test_words_of_texts_are_made_once_and_not_sorted(spark):
    texts = spark.createDataFrame([("1", "the cat sat")], "id string, text string")
    rows = phrases.annotate(texts, spark.createDataFrame([("cat", 1)], "term string, rank int"), spark.createDataFrame([("the cat",)], "key string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") <= 1 and "Window" not in plan
