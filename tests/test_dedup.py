"""Greedy deduplication against the rule, title by title."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectura.operators import dedup


def gone(links):
    out, kept = set(), set()
    around = {}
    for a, b in links:
        around.setdefault(b, set()).add(a)
    for node in sorted({n for link in links for n in link}):
        if around.get(node, set()) & kept:
            out.add(node)
        else:
            kept.add(node)
    return out


def got(spark, links):
    return {r["o"] for r in dedup.first_independent(spark.createDataFrame(links, "a long, b long")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_any_graph(spark, seed):
    rng = random.Random(seed)
    n = 60
    links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range([25, 60, 200][seed])}
    assert got(spark, sorted(links)) == gone(links)


def test_no_links(spark):
    assert got(spark, []) == set()


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    cuts, cut = [], dedup._cut
    monkeypatch.setattr(dedup, "_cut", lambda df: cuts.append(1) or cut(df))
    links = [(k, k + 1) for k in range(10_000)]
    assert got(spark, links) == set(range(1, 10_001, 2))
    assert len(cuts) < 2 * 14 + 10  # doubling: 2^14 > 10,000


def test_titles_that_follow_each_other(spark):
    """Windows over a row of words: each title is like the next one only."""
    words = [f"w{k}" for k in range(700)]
    titles = [(k, " ".join(words[k : k + 14])) for k in range(600)]
    kept = dedup.greedy_kept(spark.createDataFrame(titles, "number long, title string"), key="number")
    assert {r["number"] for r in kept.collect()} == set(range(0, 600, 2))


def test_tokens_in_common(spark):
    """A word in every title doesn't make candidates of all."""
    titles = [(k, "the of and " + " ".join(f"t{k}x{j}" for j in range(9))) for k in range(500)] + [(1000, "the of and " + " ".join(f"t7x{j}" for j in range(9)) + " of")]
    frame = spark.createDataFrame(titles, "id long, title string").select("id", F.split("title", " ").alias("tokens"))
    assert dedup.similar_pairs(frame).count() == 0  # equal sets are one node
    kept = dedup.greedy_kept(spark.createDataFrame(titles, "number long, title string"), key="number")
    assert {r["number"] for r in kept.collect()} == set(range(500))
