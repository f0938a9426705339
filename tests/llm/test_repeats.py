import random

import pytest

from lectura.llm import repeats


def brute(docs, length=100):
    seen, kept = set(), {}
    for doc, text in sorted((d, t or "") for d, t in docs if d is not None):
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(raw[k : k + length])
        kept[doc] = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
    return kept


def corpus():
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdef é") for _ in range(260))
    docs = []
    for k in range(120):
        own = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(300)))
        a, b = sorted((rnd.randrange(260), rnd.randrange(260)))
        docs.append((k, own[: len(own) // 2] + (passage[a:b] if rnd.random() < 0.5 else passage) + own[len(own) // 2 :]))
    return [*docs, (200, "a" * 700), (201, None), (202, ""), (203, "ab" * 200), (204, docs[3][1]), (205, "x" * 99), (206, "x" * 99), (207, "a" * 101), (208, passage * 3)]


@pytest.mark.parametrize("limits", [{}, {"classes": 2}, {"classes": 3, "classes_in_block": 2}, {"gram": 50}, {"classes_in_block": 3}])
def test_same_as_brute_force(spark, limits):
    docs = corpus()
    found = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), **limits)
    assert {r["doc_id"]: bytes(r["kept"]) for r in found.collect()} == brute(docs)


def test_spans_are_maximal_runs(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh") for _ in range(150))
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame([(1, text), (2, "xy" + text + "z" + text)], "doc_id long, text string")).collect()}
    assert [(s["begin"], s["end"]) for s in rows[2]["removed"]] == [(2, 152), (153, 303)] and rows[1]["removed"] == []


def test_interval_tree_lists_all_occurrences():
    import numpy as np

    words = [b"xabcd", b"yabcd", b"zabce", b"qabcf"]  # left neighbour, then the suffix
    rows = np.array([list(w[1:]) for w in words], np.uint8)
    found = {(n, tuple(sorted(m.tolist()))) for n, m in repeats.prefix_intervals(rows, np.full(4, 4), np.arange(4), np.array([w[0] for w in words]), 3)}
    assert (4, (0, 1)) in found and (3, (0, 2, 3)) in found
    same_left = list(repeats.prefix_intervals(rows[:2], np.full(2, 4), np.arange(2), np.array([120, 120]), 3))
    assert same_left == []  # the repeat begins one byte before


def test_awkward_input(awkward, empty):
    rows = repeats.remove_repeats(awkward).collect()
    assert len(rows) == 12
    assert all(len(r["kept"]) == r["n_bytes"] for r in rows if r["doc_id"] is None)
    assert repeats.remove_repeats(empty).count() == 0
