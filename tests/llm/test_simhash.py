import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectura.llm import simhash
from lectura.llm.components import components


def plain_fingerprint(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", folded)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_roots(values):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    array = np.array(values, np.uint64)
    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ array[k]) <= 3):
            a, b = find(k), find(k + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one Two", "a b c d a b c", "É ÀB c\x0bd\x0ce", "x\x00y z w " * 50, "word " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint_of((text or "").encode()) == plain_fingerprint(text)


def test_query_same_as_brute_force(spark, small):
    from lectura.llm import queries

    rows = queries.op3_simhash(spark, small).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(texts[r["doc_id"]]) for r in rows)
    roots = plain_roots([int(r["fingerprint"], 16) for r in rows])
    assert [r["component_id"] for r in rows] == [rows[k]["doc_id"] for k in roots]


@pytest.mark.parametrize("crowd", [2048, 20, 3])
def test_links_of_crowded_keys(spark, crowd):
    rnd = random.Random(3)
    values = set()
    for center in [rnd.getrandbits(64) for _ in range(5)]:
        for _ in range(250):
            value = center
            for _ in range(rnd.randrange(6)):
                value ^= 1 << rnd.randrange(64)
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes, crowd)).collect()}
    groups = {}
    for k, v in enumerate(signed):
        groups.setdefault(found.get(v, v), []).append(k)
    assert {k: min(g) for g in groups.values() for k in g} == dict(enumerate(plain_roots(values)))


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def test_awkward_input(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 12
    of = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert of[7] == 1 and of[3] == of[4] == of[2] == 2
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.filter(F.col("doc_id").isNotNull()).collect()} == {1, 2, 5, 6, 8, 9} and kept.filter("doc_id is null").count() == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
