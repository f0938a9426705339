import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectura.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def replay():
    return bpe.MergeReplay(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def check(replay, reference, texts):
    ids, begin = replay.encode(pa.array(texts, pa.large_string()))
    decoded = replay.decode(ids, begin).to_pylist()
    for k, text in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == reference.encode_ordinary(text)
        assert decoded[k] == text.encode()


def test_odd_texts(replay, reference):
    check(replay, reference, ["", " ", "  ", "a  b", " a", "b ", "\n\n x\n \n y", "tab\t x", "a" * 501, "aaa aaaa aaaaa", "don't I'll 'S", "1234567 12", "\x1c a \x1d", "\U0001f600 字 x", "x" * 10000, " \x85 a", "a b　c", "ééé", "<|endoftext|>"])
    check(replay, reference, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab  \n\t'sté 1", max_size=60)), max_size=6))
def test_any_texts(replay, reference, texts):
    check(replay, reference, texts)


def test_query(spark, small, reference):
    rows = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids, got = reference.encode_ordinary(r["text"] or ""), rows[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_forgetting_changes_nothing(replay, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 0)
    check(replay, reference, ["one two", "two three"])
    check(replay, reference, ["three one", "one two"])


def test_awkward_input(awkward, empty, reference):
    rows = bpe.encode(awkward, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 12 and all(r["ids"] == reference.encode_ordinary(r["text"] or "") for r in rows)
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN, ids="own_ids", decoded="raw").count() == 0
