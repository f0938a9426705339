import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectura.llm import pii

TEXT = (
    "Mr. John Smith (john.smith@corp.example.org, +1 (017) 555-7713) paid 4111 1111 1111 1111 and 4713332104704538. Smith's IP 97.51.17.173 and 10.0.0.7; Mary Jones and Mary. "
    'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" DE89 3704 0044 0532 0130 00 SSN 123-45-6789 Иван Петров'
)


def luhn(value):
    digits = re.sub(r"\D", "", value)
    return pii._check_digit(digits[:-1]) == int(digits[-1])


def test_everything_is_replaced():
    text, found = pii.replaced(TEXT, "k")
    assert {e["type"] for e in found} == {"NAME", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "IBAN", "SSN"}
    for e in found:
        old = TEXT[e["begin"] : e["end"]]
        assert old not in text and e["surrogate"] in text and len(old) == len(e["surrogate"]) or e["type"] in ("NAME", "IP")
    by = {TEXT[e["begin"] : e["end"]]: e["surrogate"] for e in found}
    assert luhn(by["4111 1111 1111 1111"]) and luhn(by["4713332104704538"]) == luhn("4713332104704538")
    assert by["10.0.0.7"].startswith("10.") and not by["97.51.17.173"].startswith("10.")
    assert by["John"] in pii.pool("m", "Latin") and by["Mary"] in pii.pool("f", "Latin") and by["Иван"] in pii.pool("m", "Cyrillic")
    assert re.fullmatch("[А-Я][а-я]+", by["Петров"]) and text.count(by["Smith"]) == 2 and text.count(by["Mary"]) == 2
    iban = by["DE89 3704 0044 0532 0130 00"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@pytest.mark.parametrize("text", ["", "No private data here, 12 apples and 3.14.", "See https://example.com/a1 and version 1.2.3", "At 12:30 on 2024-01-31.", "An Ad Hoc Title"])
def test_clean_texts_stay(text):
    assert pii.replaced(text, "k") == (text, [])


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_one_cycle_through_all_values(size):
    cycle, seen, value = pii.Cycle("k", size), [], 0
    for _ in range(size):
        seen.append(value)
        value = cycle.after(value)
    assert value == 0 and len(set(seen)) == size


@settings(max_examples=60, deadline=None)
@given(st.sets(st.from_regex(r"[a-z]{2,6}\.[0-9]{2}@mail[0-9]\.example\.com", fullmatch=True), min_size=2, max_size=30))
def test_distinct_stays_distinct(mails):
    made = {pii.surrogate("k", "EMAIL", m) for m in mails}
    assert len(made) == len(mails) and all(re.fullmatch(r"[a-z]{2,6}\.[0-9]{2}@[a-z]{4}[0-9]\.example\.com", m) for m in made)


def test_same_key_same_surrogate_and_other_key_another():
    assert pii.surrogate("a", "CARD", "4713332104704538") == pii.surrogate("a", "CARD", "4713332104704538") != pii.surrogate("b", "CARD", "4713332104704538")


def test_small_domains_keep_apart():
    text = " ".join(f"{k}.{j}.0.1" for k in (10,) for j in range(40))
    new, found = pii.replaced(text, "k")
    assert len({e["surrogate"] for e in found}) == 40 and not {e["surrogate"] for e in found} & set(text.split())


def test_awkward_input(awkward, empty):
    rows = pii.replace_private(awkward, "k").collect()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    assert len(rows) == 12 and all(r["text"] == texts[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert pii.replace_private(awkward, "k", entities=None).columns == awkward.columns
    assert pii.replace_private(empty, "k").count() == 0


@pytest.mark.parametrize("text", ["API KEY: AbCdEfGhIjKl", "TOKEN=abcdefghijkl", "pwd: hunterhunter", "bearer: QwErTyUiOp", "x ghp_" + "aBcDeFgHiJ" * 3, "AKIA" + "ABCDEFGH" * 2, "the key is " + "abcdef" * 6])
def test_secrets_without_digits(text):
    new, found = pii.replaced(text, "k")
    assert [e["type"] for e in found] == ["SECRET"] and text[found[0]["begin"] : found[0]["end"]] not in new


@pytest.mark.parametrize("text", ["The key: understanding", "a token: something", "the secret: patience."])
def test_prose_is_no_secret(text):
    assert pii.replaced(text, "k") == (text, [])


@pytest.mark.parametrize(("text", "names"), [
    ("Mrs Priya Sharma came. Priya left.", ["Priya", "Sharma", "Priya"]), ("王小明先生来了", ["王小明"]), ("Pan Dr Łukasz Wójcik", ["Łukasz", "Wójcik"]), ("Dr. Şükrü Özdemir", ["Şükrü", "Özdemir"]),
    ("Mr. J. Doe and Doe", ["J.", "Doe", "Doe"]), ("Mr. John Smith Prof. Anna Weber", ["John", "Smith", "Anna", "Weber"]),
])
def test_names(text, names):
    new, found = pii.replaced(text, "k")
    assert [text[e["begin"] : e["end"]] for e in found] == names and all(e["type"] == "NAME" for e in found)
    by = {text[e["begin"] : e["end"]]: e["surrogate"] for e in found}
    assert not set(names) & set(by.values()) and len(set(by.values())) == len(by) and ("Prof." in new) == ("Prof." in text)
    if "Priya" in by:
        assert by["Priya"].split("-")[0] in pii.pool("f", "Latin") and by["Priya"].endswith(pii.surrogate("k", "NAME", "Priya"))


def test_names_agree_across_documents():
    names = [n for kind in pii.GIVEN if kind[1] == "Latin" for n in pii.GIVEN[kind]]
    alone = {n: pii.replaced(f"{n} Miller", "k")[1][0]["surrogate"] for n in names}
    text = " and ".join(f"{n} Miller" for n in names)
    assert {text[e["begin"] : e["end"]]: e["surrogate"] for e in pii.replaced(text, "k")[1] if text[e["begin"] : e["end"]] in alone} == alone
    assert len(set(alone.values())) == len(names) and not set(alone.values()) & set(names)


def plainly_replaced(text, key):
    """The query's rows once more, from the found spans alone."""
    out, at = "", 0
    for e in pii.replaced(text, key)[1]:
        out, at = out + text[at : e["begin"]] + e["surrogate"], e["end"]
    return out + text[at:]


def test_query(spark, small):
    from lectura.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op7_surrogates(spark, small).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {k: t and plainly_replaced(t, "no secret") for k, t in texts.items()}
    pairs = {}
    for k, t in texts.items():
        for e in pii.replaced(t or "", "no secret")[1]:
            if e["type"] not in ("NAME", "EMAIL"):
                pairs.setdefault((e["type"], t[e["begin"] : e["end"]]), set()).add(e["surrogate"])
    assert pairs and sum(len(v) > 1 for v in pairs.values()) == 0  # one surrogate for an entity, whatever its document
