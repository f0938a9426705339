import zlib

from lectura.llm import langid, queries


def test_held_out_accuracy(spark, small):
    rows = queries.op10_string_kernel(spark, small).collect()
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(known[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_label_is_no_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    some = docs.select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    a = {r["doc_id"]: r["lang_pred"] for r in langid.identify(some, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.identify(some.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_sample_is_bounded_and_fixed(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from pyspark.sql import functions as F

    texts, labels = langid.sample_labelled(docs, "text", "lang", F.xxhash64("doc_id"), sample=5)
    assert all(labels.count(x) <= 5 for x in set(labels)) and (texts, labels) == langid.sample_labelled(docs.repartition(7), "text", "lang", F.xxhash64("doc_id"), sample=5)


def test_kernel_scores_are_those_of_the_definition():
    import numpy as np

    texts = ["aa bb ab", "bb ba ab", "xx yy xy", "yy yx xx"]
    model = langid.train(texts, ["p", "p", "q", "q"], landmarks=4, ridge=1e-9)
    assert model.predict(["ab ba aa", "xy xx yx", "...", None, ""])[0] == ["p", "q", "und", "und", "und"]
    matrix, norm = langid._presences(texts)
    kernel = (matrix @ matrix.T) / np.outer(norm, norm)
    sets = [set(langid._spectrum(t).tolist()) for t in texts]
    assert all(abs(kernel[i, j] - len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5) < 1e-6 for i in range(4) for j in range(4))


def test_awkward_input(awkward, empty):
    model = langid.fit(awkward)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == 12 and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward, langid.fit(empty)).collect()} == {"und"}
