import math
import re
from collections import Counter

import numpy as np
import pytest

from lectura.llm import impact, queries
from tests.oracle import same_rows, views


def plain(docs, items, k=10):
    """The formula, document by document."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(low))
    counted = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = Counter(w for _, t in counted for w in set(t))
    counted = [(d, len(t), Counter(t)) for d, t in counted]
    rows = []
    for item, text in set(items):
        found = []
        for d, n, tf in counted:
            m = 100 - 75 + 75 * n * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in terms(text) if tf[w])
            if score > 0:
                found.append((-score, d is not None, d))
        rows += [(item, r + 1, d, -score) for r, (score, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(rows, key=repr)


def got(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


def test_query(spark, small, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    expected = plain(docs, items)
    assert got(queries.op12_impact_search(spark, small)) == expected
    monkeypatch.setattr(impact, "BLOCK_DOCS", 70)
    monkeypatch.setattr(impact, "PASS_BYTES", 4000)
    assert got(queries.op12_impact_search(spark, small)) == expected


def test_sql(spark, small):
    mine, theirs = same_rows(queries.op12_impact_search(spark, small), views(small).sql(queries.oracle_sql()["op12_impact_search"]))
    assert mine == theirs and mine


def test_carries_and_descent():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 200):
        n = size * 4
        pairs = np.unique(np.stack([rng.integers(0, 6, n), rng.integers(0, size, n)]), axis=1)
        values = rng.integers(1, 1 << rng.integers(1, 36), pairs.shape[1])
        block = impact.Block(size, pairs[0], pairs[1], values)
        for query in ([(0, 1)], [(0, 1), (1, 5), (2, 2), (3, 1), (9, 1)], [(4, 7), (5, 3)]):
            score = np.zeros(size, np.int64)
            for term, times in query:
                np.add.at(score, pairs[1][pairs[0] == term], times * values[pairs[0] == term])
            for k in (1, 3, 10):
                best = sorted(np.flatnonzero(score > 0).tolist(), key=lambda p: (-score[p], p))[:k]
                assert block.best(query, k) == sorted((p, int(score[p])) for p in best)


@pytest.mark.parametrize("texts", [[None, "", "..", "a A b", "a a a", "a a a", "É é 字 1x", "\x00nul a"]])
def test_awkward_input(spark, awkward, empty, texts):
    docs = [(None if i == 4 else i % 6, t) for i, t in enumerate(texts)]
    items = [(1, "a B"), (1, "a B"), (1, "é"), (None, "nul 1X"), (3, None), (4, "nothing here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumnsRenamed({}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(impact.search(frame, asked)) == plain(docs, items)
    own = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(impact.search(awkward, asked)) == plain(own, items)
    assert impact.search(empty, asked).count() == 0 and impact.search(frame, asked.limit(0)).count() == 0
