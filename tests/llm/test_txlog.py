import random
import zlib

import numpy as np
import pytest

from lectura.llm import queries, txlog
from tests.oracle import same_rows, views

COLUMNS = "at long, source string, kind string, key long, value long"


def plain(log, per_epoch=16):
    """The rules, record by record."""
    undone, open_of, store, states, commits = {}, {}, {}, [], 0
    total = lambda: (len(store), sum(store.values()))
    for at, source, kind, key, value in sorted((r for r in log if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "", -(2**63) if r[4] is None else r[4])):
        held = open_of.setdefault(source, [])
        if kind == "commit":
            for entry in held:
                if entry != "savepoint":
                    store.pop(entry[1], None)
                    if entry[2] is not None:
                        store[entry[1]] = entry[2]
            open_of[source] = []
            commits += 1
            if commits % per_epoch == 0:
                states.append(total())
        elif kind == "abort":
            undone |= {e[0]: ("abort", at, e[1]) for e in held if e != "savepoint"}
            open_of[source] = []
        elif kind == "savepoint":
            held.append("savepoint")
        elif kind == "rollback":
            while held and held[-1] != "savepoint":
                e = held.pop()
                undone[e[0]] = ("rollback", at, e[1])
        else:
            held.append((at, key, value))
    for held in open_of.values():
        undone |= {e[0]: ("abort", None, e[1]) for e in held if e != "savepoint"}
    if commits % per_epoch:
        states.append(total())
    return undone, states


def resolved(spark, log):
    changes, commits = txlog.reassemble(spark.createDataFrame(log, COLUMNS).repartition(3))
    undone = {r["at"]: (r["what"], r["by"], r["key"]) for r in changes.filter("what <> 'commit'").collect()}
    return undone, [(r["n"], r["total"]) for r in txlog.states(changes, commits).orderBy("epoch").collect()]


def invented(seed, n, sources, weights):
    rng = random.Random(seed)
    kinds = ("change", "commit", "abort", "savepoint", "rollback")
    places = rng.sample(range(n * 3), n)
    return [(p, rng.choice(sources), rng.choices(kinds, weights)[0], rng.randrange(12), rng.choice([None, *range(5)])) for p in places]


@pytest.mark.parametrize(("seed", "sources", "weights"), [(1, ["a", "b", None], (8, 1, 1, 2, 2)), (2, ["a"] * 9 + ["b"], (30, 0.2, 0.3, 1, 1)), (3, ["a"], (20, 0, 0, 3, 3)), (4, ["a", "b"], (1, 3, 3, 2, 2)), (5, ["a", "b", "c"], (5, 0, 1, 3, 1))])
def test_against_the_rules(spark, monkeypatch, seed, sources, weights):
    monkeypatch.setattr(txlog, "CHUNK_ROWS", 40)
    monkeypatch.setattr(txlog, "FAN", 3)
    log = invented(seed, 500, sources, weights)
    assert resolved(spark, log) == plain(log)


def test_heights_against_a_scan():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 65, 300):
        height = rng.integers(0, 9, n)
        asked = np.arange(n)
        assert txlog.first_lower(height, asked).tolist() == [next((j for j in range(i + 1, n) if height[j] < height[i]), n) for i in range(n)]


def test_awkward_logs(spark):
    assert resolved(spark, []) == ({}, [])
    assert resolved(spark, [(1, "a", "change", 1, 5), (None, "a", "commit", None, None)]) == ({1: ("abort", None, 1)}, [])
    same = [(1, "a", "change", None, 7), (1, "a", "change", None, 7), (2, "a", "commit", None, None), (2, "a", "commit", None, None)]
    assert resolved(spark, same) == ({}, [(1, 7)])
    assert resolved(spark, [(k, None, "commit", None, None) for k in range(17)]) == ({}, [(0, 0), (0, 0)])


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["toxic"] == 1}
    log = []
    for d in docs:
        h = zlib.crc32(str(d["doc_id"]).encode())
        turn, key = h % 41, h // 100 % 3000
        kind = "commit" if turn < 2 else "abort" if turn == 2 else "savepoint" if turn < 5 else "rollback" if turn < 7 else "change"
        log.append((d["doc_id"], d["source"], kind, key, None if d["text"] is None or d["doc_id"] in toxic else zlib.crc32(f"{key}:{d['text']}".encode())))
    undone, states = plain(log)
    rows = queries.op11_undo_log(spark, small).collect()
    assert {r["id"]: (r["kind"], r["n"], r["value"]) for r in rows if r["kind"] != "state"} == undone
    assert [(r["n"], r["value"]) for r in sorted((r for r in rows if r["kind"] == "state"), key=lambda r: r["id"])] == states


def test_sql(spark, small):
    mine, theirs = same_rows(queries.op11_undo_log(spark, small), views(small).sql(queries.oracle_sql()["op11_undo_log"]))
    assert mine == theirs and mine
