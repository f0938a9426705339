"""Every query of the library against its SQL, or for its rows where SQL can't say it."""

from __future__ import annotations

import re

import pytest
from oracle import same_rows, views

from lectura import plans

QUERIES, SQL = plans.all_queries(), plans.oracle_sql()
#: Queries whose conditions no row of the smallest tables meets.
MAY_BE_EMPTY = {"p4_search_literal", "p2_combined", "p2_by_source", "a3_priority_max", "d2_greedy_kept"}


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    mine, theirs = same_rows(QUERIES[name](spark, small), con.sql(SQL[name]))
    assert mine == theirs
    assert mine or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranks_without_one_sort(spark, small):
    from collections import Counter

    from lectura.plans import library

    rows = library.lexicon(spark, small).collect()
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").filter("lang = 'en'").collect()]
    counts = Counter(t for x in texts if x for t in re.findall("[a-z][a-z'-]*", x.lower()) if len(t) >= 2)
    wanted = {t: k + 1 for k, (t, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0])))}
    assert {r["term"]: r["rank"] for r in rows} == wanted and len(rows) == len(wanted)


def test_chapters_of_whole_texts(spark, small):
    from pyspark.sql import functions as F

    from lectura.functions import prose, reflow

    books = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        books.setdefault(r["doc_id"] // 20, []).append(f"CHAPTER {r['doc_id']}. Of {r['source']}\n\n{r['text']}")
    raw = spark.createDataFrame([(b, "\n\n".join(blocks)) for b, blocks in books.items()], "book long, raw string").select("book", reflow.book_blocks(F.col("raw")).alias("blocks")).collect()
    wanted = {(r["book"], k): (title, len(text)) for r in raw for k, (title, text) in enumerate(prose.split_chapters(r["blocks"]))}
    rows = QUERIES["t32_chapters"](spark, small).collect()
    assert {(r["book"], r["idx"]): (r["title"], r["chars"]) for r in rows} == wanted
    titles = [t for t, _ in wanted.values()]
    assert len(titles) > 0.9 * sum(map(len, books.values()))  # nearly every document's heading is found


def test_known_words_stand_for_their_forms(spark, small):
    from lectura.plans import library

    ranks = {r["term"]: r["rank"] for r in library.lexicon(spark, small).collect()}
    for r in QUERIES["j12_lookup_fallback"](spark, small).collect():
        assert r["rank"] == ranks.get(r["entry"]) and (r["term"] not in ranks or r["entry"] == r["term"])


def test_levels_count_sentences_once_a_text(spark, small):
    plan = QUERIES["l15_l16_levels"](spark, small)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    exploded = [k for k, line in enumerate(plan) if "Generate explode" in line]
    counted = [k for k, line in enumerate(plan) if "[^.!?]+" in line]
    assert exploded and counted and min(counted) > min(exploded)  # below the explode, not above it
    assert not any("Window" in line for line in plan)  # words beyond rank 1,000 need no rank
