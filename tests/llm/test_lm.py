import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectura.llm import lm, queries


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", folded), None]


def test_base_and_model(spark, small):
    rows = queries.op6_log_bilinear(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    counts = Counter(t for d, x in texts.items() if zlib.crc32(str(d).encode()) % 10 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine = tokens(texts[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in mine), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(counts[t] > 0 for t in mine), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    seen = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_context_is_learned_and_probabilities_are_normalised(spark):
    pairs = ["red apple", "blue sky"]
    docs = [(k, " ".join(pairs[(k + j) % 2 if j % 3 else k % 2] for j in range(30))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    corpus = lm.corpus_of(lm.count_words(df), 16, 100, rare=4)
    weights = lm.train(df, corpus, rounds=4)
    k = corpus.outside + 1
    scorer = lm.Scorer(weights, corpus.outside)
    every = np.array([[a, b, c] for a in range(k) for b in range(k) for c in range(corpus.outside)])
    # each context followed by each class, as texts of three tokens
    flat, begin = every[every.max(1) < corpus.outside].ravel(), None
    begin = np.arange(0, flat.size + 1, 3)
    logs = scorer.log10(flat, begin)[2::3]
    share = (10**logs).reshape(-1, corpus.outside).sum(1)
    assert share == pytest.approx(np.ones_like(share), abs=1e-4)
    scored = {r["doc_id"]: r for r in lm.score(df, corpus, lm.count_words(df), weights, ["doc_id"]).collect()}
    assert sum(r["score"] for r in scored.values()) > 0.8 * sum(r["base_score"] for r in scored.values())


def test_rare_words_meet_their_counts_by_a_join(spark):
    docs = [(k, f"common word{k % 7} rare{k}") for k in range(50)] + [(100, "never seen")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r["doc_id"]: r for r in lm.learn_and_score(df, F.col("doc_id") < 100, ["doc_id"], classes=5, head=3, rare=2).collect()}
    usual = {r["doc_id"]: r for r in lm.learn_and_score(df, F.col("doc_id") < 100, ["doc_id"], classes=5, rare=2).collect()}
    for d, r in whole.items():
        assert r["base_score"] == pytest.approx(usual[d]["base_score"]) and r["score"] == pytest.approx(usual[d]["score"], rel=1e-6) and r["n_known"] == usual[d]["n_known"]
    assert whole[100]["n_known"] == 1


def test_awkward_input(awkward, empty):
    rows = lm.learn_and_score(awkward, F.col("doc_id") != 5, ["doc_id"]).collect()
    assert len(rows) == 12 and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm.learn_and_score(empty, F.lit(True), ["doc_id"]).count() == 0
    untrained = lm.learn_and_score(awkward, F.lit(False), ["doc_id"]).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(r["base_score"] == 0 for r in untrained)


def test_held_out_gain_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    scores = []
    for parts in (3, 17):
        rows = lm.learn_and_score(docs.repartition(parts).withColumn("out", held_out), ~F.col("out"), ["doc_id", "out"], shard=200_000).collect()
        out = [r for r in rows if r["out"]]
        n = sum(r["n_tokens"] for r in out)
        assert sum(r["score"] for r in out) / n > sum(r["base_score"] for r in out) / n + 0.03  # shards far smaller than usual
        scores.append({r["doc_id"]: r["score"] for r in rows})
    assert scores[0] == pytest.approx(scores[1], rel=1e-3)
