import random

import pytest

import corpus_pipeline as cp
from lectura.llm import simhash


def _planted(rnd, groups=40, crowd=60):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([4, 60, 200]))]
        for changes in (0, 1, 2, 4):
            new = list(base)
            for _ in range(changes):
                new[rnd.randrange(len(new))] = word()
            docs.append(" ".join(new))
    base = [word() for _ in range(120)]
    for _ in range(crowd):
        new = list(base)
        new[rnd.randrange(120)] = word()
        docs.append(" ".join(new))
    return [(k, t) for k, t in enumerate([*docs, docs[0].upper(), "", None])]


def _brute(docs):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    held, root = [(k, sets(t)) for k, t in docs], {k: k for k, _ in docs}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (a, x) in enumerate(held):
        for b, y in held[k + 1 :]:
            if 10 * len(x & y) >= 8 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {k: top(k) for k in root}


@pytest.mark.parametrize("block", [1 << 19, 3_000])
def test_same_as_brute_force(spark, block):
    docs = _planted(random.Random(3))
    wanted = _brute(docs)
    rows = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == wanted and len(rows) == len(docs)


def test_stage_drops_near_copies(spark):
    docs = _planted(random.Random(4))
    left = cp.keep_one_of_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in left.collect()} == {k for k, v in _brute(docs).items() if k == v}


def test_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text), (None, text), (None, text + " more"), (None, "other words here"), (5, "a b c"), (None, "A b c"), (5, "a b c"), (6, "a b c")]
    left = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"]) == [(5, "a b c"), (5, "a b c")]
    bare = [r["text"] for r in left if r["doc_id"] is None]
    assert len(bare) == 2 and "other words here" in bare
