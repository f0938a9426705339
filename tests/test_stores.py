"""Versions with several writers, chunks with a stop, refreshes with state."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectura.api import Library
from lectura.plans import library as L
from lectura.sources import versions
from lectura.sources.ledger import Ledger
from lectura.sources.versions import Overtaken, Versions, create_once
from lectura.streaming import refresh


def table_of(v, version=None):
    return {r["id"]: r["n"] for r in v.read(version).collect()}


@pytest.fixture
def two(spark, tmp_path):
    return [Versions(spark, f"{tmp_path}/t", "id string, n long", ["id"]) for _ in range(2)]


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "id string, n long")


def test_interleaved_writers_lose_nothing(spark, two):
    a, b = two
    assert table_of(a) == {} and a.version() == 0
    a.replace(rows(spark, ("x", 1), ("y", 2), ("z", 3)))
    calls = []

    def slow(df):
        calls.append(1)
        if len(calls) == 1:
            b.update(lambda d: d.filter("id <> 'z'").withColumn("n", F.col("n") * 10))
        return df.filter("id = 'x'").withColumn("n", F.col("n") + 1).unionByName(rows(spark, ("new", 7)))

    a.update(slow)
    assert len(calls) == 2 and table_of(b) == {"x": 11, "y": 20, "z": 3, "new": 7}
    assert table_of(a, 1) == {"x": 1, "y": 2, "z": 3} and table_of(a, 2) == {"x": 10, "y": 20, "z": 3}


def test_threads(spark, two, monkeypatch):
    monkeypatch.setattr(versions, "COMPACT", 4)
    monkeypatch.setattr(versions, "TRIES", 100)
    two[0].replace(rows(spark, ("x", 0), ("y", 0)))
    failed = []

    def work(v):
        try:
            for _ in range(4):
                v.update(lambda d: d.filter("id = 'x'").withColumn("n", F.col("n") + 1))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(v,)) for v in two]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and table_of(two[0]) == {"x": 8, "y": 0}


def test_rows_go_and_come(spark, two):
    a, b = two
    a.update(lambda d: rows(spark, ("x", 1), ("y", None), ("x", 1)))
    b.update(lambda d: d.filter("id = 'x'").withColumn("__gone", F.lit(True)))
    assert table_of(a) == {"y": None}
    assert a.compact() and table_of(b) == {"y": None}
    a.update(lambda d: rows(spark, ("x", 5)).withColumn("more", F.lit("unknown columns are left out")))
    a.update(lambda d: d.limit(0))
    assert table_of(b) == {"x": 5, "y": None}


def test_a_whole_table_isnt_written_over_a_change(spark, two):
    a, b = two
    at = a.replace(rows(spark, ("x", 1)))
    b.update(lambda d: rows(spark, ("y", 2)))
    with pytest.raises(Overtaken):
        a.replace(rows(spark, ("x", 9)), read_at=at)
    assert table_of(a) == {"x": 1, "y": 2}
    a.replace(rows(spark, ("x", 9)), read_at=a.version())
    assert table_of(b) == {"x": 9}


def test_a_file_is_made_once(spark, tmp_path):
    path = f"{tmp_path}/deep/f.json"
    assert create_once(spark, path, "a") and not create_once(spark, path, "b") and open(path).read() == "a"
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["f.json"]


def test_two_libraries(spark, small, tmp_path):
    libs = [Library(spark, str(tmp_path / "lib"), L.now_column) for _ in range(2)]
    libs[0].replace("articles", L.articles(spark, small).limit(5))
    a, b = [r["id"] for r in libs[0].table("articles").select("id").limit(2).collect()]
    original, once = libs[0].table, []

    def overtaken(name):
        df = original(name)
        if not once and name == "articles":
            once.append(1)
            libs[1].set_article_liked(b, True)  # another writer between reading and writing
        return df

    libs[0].table = overtaken
    libs[0].delete_article(a)
    left = {r["id"]: r["liked"] for r in libs[1].table("articles").collect()}
    assert a not in left and len(left) == 4 and left[b] is True


def test_stopped_and_resumed(spark, tmp_path):
    frame = spark.range(100).withColumn("t", F.concat(F.lit("r"), "id"))
    ledger, seen = Ledger(spark, f"{tmp_path}/l"), []
    assert ledger.read() is None
    done = ledger.write(frame, "run", F.floor(F.col("id") / 10), stop=lambda: len(seen) == 4, tell=seen.append)
    assert (done.chunks, done.done, done.rows) == (10, 4, 40) and [p.done for p in seen] == [1, 2, 3, 4]
    assert {r["id"] for r in ledger.read().collect()} == set(range(40))
    again = Ledger(spark, f"{tmp_path}/l")  # another driver goes on; what it is given then doesn't matter
    done = again.write(frame.limit(0), "run", F.lit(0))
    assert (done.done, done.rows) == (10, 100) and sorted(r["id"] for r in again.read().collect()) == list(range(100))
    unbroken = Ledger(spark, f"{tmp_path}/m")
    unbroken.write(frame, "run", F.floor(F.col("id") / 10))
    assert sorted(unbroken.read().collect()) == sorted(ledger.read().collect())
    assert ledger.write(frame, "run", F.lit(1)).rows == 100  # nothing twice
    ledger.write(frame.filter("id < 5"), "next", F.lit(3))
    assert ledger.read().count() == 105


def test_nothing_to_write(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    done = ledger.write(spark.range(0), "run", F.lit(0))
    assert (done.chunks, done.done, done.rows) == (0, 0, 0) and ledger.read() is None


def test_half_a_stage_is_written_again(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    spark.range(7).withColumn("__chunk", F.lit(9)).write.partitionBy("__chunk").parquet(f"{tmp_path}/l/staged/run")  # its driver died before the list
    assert ledger.read() is None
    ledger.write(spark.range(3), "run", F.lit(0))
    assert sorted(r["id"] for r in ledger.read().collect()) == [0, 1, 2]


def test_refresh_state(spark, tmp_path):
    """Fetches in many batches against the rule, fetch by fetch."""
    rng, start = random.Random(1), datetime(2024, 1, 1)
    fetches = {}
    for feed in ("a", "b", None):
        tag = 0
        for k in range(6):
            tag += rng.random() < 0.6 or k == 0
            n = rng.choice([1, 3, 50])
            share = rng.choice([0.0, 0.5, 1.0])
            fetches[feed, k] = (str(tag) if rng.random() < 0.9 else None, [(4000 if rng.random() < share else 1500, start + timedelta(hours=rng.randrange(99))) for _ in range(n)])
    schema = "feed string, fetched timestamp, tag string, place int, chars int, published timestamp"
    for cut in ((0, 1, 2), (3,), (4, 5)):
        rows = [(f, start + timedelta(days=100 + k), tag, i, c, at) for (f, k), (tag, some) in fetches.items() if k in cut for i, (c, at) in enumerate(some)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        run = refresh.refreshed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(r["feed"], r["fetched"]): (r["status"], r["entries"], r["full_texts"], r["bar"], round(r["ratio"], 9), r["newest"]) for r in spark.read.schema(refresh.OUTPUT).parquet(f"{tmp_path}/out").collect()}
    wanted = {}
    for feed in ("a", "b", None):
        tag, ratio, newest = None, -1.0, None
        for k in range(6):
            now, some = fetches[feed, k]
            key = (feed, start + timedelta(days=100 + k))
            if now is not None and now == tag:
                wanted[key] = ("unchanged", 0, 0, None, round(ratio, 9), newest)
                continue
            bar = 1200 if ratio >= 0.7 else 3200 if 0 <= ratio <= 0.2 else 2000
            some = some[:40]
            full = sum(c >= bar for c, _ in some)
            tag, ratio, newest = now, full / len(some), max([newest, *(at for _, at in some)], key=lambda t: t or datetime.min)
            wanted[key] = ("changed", len(some), full, bar, round(ratio, 9), newest)
    assert got == wanted and any(w[0] == "unchanged" for w in wanted.values())
