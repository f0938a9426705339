import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from lectura.llm import bpe, pii


def test_stages(spark, small):
    assert [n for n, _ in cp.STAGES] == ["language", "near_copies", "benchmark", "personal_data", "token_ids"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = cp.keep_known_languages(spark, docs, small)
    assert first.columns == docs.columns and first.count() >= 0.98 * docs.count()
    second = cp.keep_one_of_near_copies(spark, first, small)
    texts = [r["text"] for r in second.collect()]
    assert len(texts) == len(set(texts)) and second.count() < first.count()
    third = cp.drop_benchmark_leaks(spark, second, small)
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(i[12:] in r["text"] for r in third.collect() for i in items)
    fourth = {r["doc_id"]: r["text"] for r in cp.replace_personal_data(spark, third, small).collect()}
    assert fourth == {r["doc_id"]: pii.replaced(r["text"], "no secret")[0] for r in third.collect()}


def test_run(spark, small):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(cp.RANKS)), special_tokens={})
    rows = cp.run(spark, small).collect()
    assert rows and all(r["ids"] == reference.encode_ordinary(r["text"]) for r in rows)


@pytest.mark.parametrize("number", range(5))
def test_awkward_input(spark, awkward, empty, small, number):
    _, stage = cp.STAGES[number]
    columns = [c for c in awkward.columns if number < 4 or c != "ids"]  # the last stage replaces it
    out = stage(spark, awkward, small)
    assert out.columns[: len(columns)] == columns and out.select("*").count() <= 12
    assert stage(spark, empty, small).count() == 0
