import hashlib
import re

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectura.llm import queries, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return wordbpe.WordVocabulary(file.read())


def ids_of(vocabulary, text):
    names, flat, count = vocabulary.split_all(pa.array(re.split(r"[ \t-\r]+", text), pa.large_string()))
    assert count.sum() == len(flat)
    return [i for w in flat for i in vocabulary.encode(names[w])]


def test_odd_texts(vocabulary, reference):
    odd = ["", " ", "don't I'll 'S", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "x" * 5000, "ÀÉ Σίσυφος ΑΣ", "é é क़", "12 ½ ٣", "字字 \U0001f600‍", "a\x85b　c \x1cd", "Ǆ İ", "!!!???", "\x00"]
    for text in odd:
        assert ids_of(vocabulary, text) == reference.encode(text, add_special_tokens=False).ids, text


def test_every_letter(vocabulary, reference):
    points = [*range(1, 0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x1D400, 0x1D800), *range(0x1F300, 0x1F400)]
    texts = [f"a{chr(c)}b{chr(c)} {chr(c)}1A" for c in points if not 0xD800 <= c < 0xE000]
    for text, coded in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids_of(vocabulary, text) == coded.ids, hex(ord(text[1]))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abE' 'tsréé1!<|endoftext|>", max_size=60)))
def test_any_text(vocabulary, reference, text):
    assert ids_of(vocabulary, text) == reference.encode(text, add_special_tokens=False).ids


def test_query(spark, small, reference, monkeypatch):
    monkeypatch.setattr(wordbpe, "FREQUENT", 50)
    monkeypatch.setattr(wordbpe, "HELD_ROWS", 100)
    rows = {r["doc_id"]: r for r in queries.op13_word_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids, got = reference.encode(r["text"] or "", add_special_tokens=False).ids, rows[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_input(awkward, empty, reference, monkeypatch):
    monkeypatch.setattr(wordbpe, "BLOCK_BYTES", 100)
    coded = wordbpe.encode(awkward, PATH, decoded="said")
    rows = coded.collect()
    assert len(rows) == 12 and coded.columns == [c for c in awkward.columns if c != "ids"] + ["ids", "said"]
    for r in rows:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["said"]) == (ids, reference.decode(ids, skip_special_tokens=False))
    assert wordbpe.encode(empty, PATH, keep_text=False).count() == 0


def test_decode_by_a_join(spark, reference):
    rows = [(1, [320, 49407, 321]), (2, []), (3, None), (4, [320, 49407, 321])]
    got = wordbpe.decode(spark.createDataFrame(rows, "n int, ids array<int>"), PATH).collect()
    assert {r["n"]: r["decoded"] for r in got} == {n: None if ids is None else reference.decode(ids, skip_special_tokens=False) for n, ids in rows}
