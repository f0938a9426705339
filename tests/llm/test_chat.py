import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same_rows, views
from pyspark.sql import functions as F

from lectura.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def test_windows(spark):
    turns = [(1, 0, "system", "be kind"), *((1, k, ("user", "assistant")[k % 2 == 0], f"w{k} " * 10) for k in range(1, 9))]
    rows = chat.windows(spark.createDataFrame(turns, SCHEMA), budget=40, history=10).orderBy("window").collect()
    assert len(rows) > 2 and all(r["formatted"].startswith("<turn system>\nbe kind\n</turn>\n") for r in rows)
    for r in rows:
        for p in r["parts"]:
            body = r["formatted"][p["begin"] : p["begin"] + p["length"]]
            assert "<" not in body and r["formatted"][p["begin"] + p["length"] :].startswith("\n</turn>\n")
            assert not (p["repeated"] and p["loss"])
    assert sum(p["loss"] for r in rows for p in r["parts"]) == 4
    assert all(r["n_tokens"] <= 40 for r in rows) and any(p["repeated"] for r in rows for p in r["parts"][1:])


def plain_spans(sizes, system, budget, history, block):
    """Own and repeated turns of each window, by going through the turns."""
    spans = []
    for n, size in enumerate(sizes):
        room = budget - system - (history if len(spans) > 1 else 0)
        if not spans or n % block == 0 or sum(sizes[k] for k in spans[-1]) + size > room:
            spans.append([])
        spans[-1].append(n)
    out = [(spans[0], [])]
    for before, own in zip(spans, spans[1:]):
        most = min(history, budget - system - sum(sizes[k] for k in own))
        out.append((own, [k for k in before if sum(sizes[j] for j in before if j >= k) <= most]))
    return out


@pytest.mark.parametrize(("budget", "history", "block", "system"), [(40, 10, 1024, 5), (40, 10, 7, 0), (20, 15, 4, 30), (512, 128, 1024, 50)])
def test_same_as_going_through_the_turns(spark, budget, history, block, system):
    rnd, rows, sizes = random.Random(budget + block), [], {}
    for c in range(6):
        sizes[c] = [rnd.choice([0, 1, 3, 8, 12, 39, 60, 300]) for _ in range(rnd.randrange(1, 40))]
        rows += [(c, k, "system" if system and not k else "assistant", "w " * s) for k, s in enumerate([system, *sizes[c]] if system else sizes[c])]
    got = {}
    for r in chat.windows(spark.createDataFrame(rows, SCHEMA), budget=budget, history=history, block=block).collect():
        got[r["conv_id"], r["window"]] = ([p["length"] // 2 for p in r["parts"]], [p["repeated"] for p in r["parts"]], r["n_tokens"])
    for c, own in sizes.items():
        shifted = [system, *own] if system else own
        spans = plain_spans([0, *own] if system else own, system, budget, history, block)
        assert sum(k[0] == c for k in got) == len(spans)
        for w, (mine, again) in enumerate(spans):
            again = [k for k in again if not (system and k == 0)]
            first = [0] if system and w else []
            lengths, repeated, tokens = got[c, w]
            assert lengths == [shifted[k] for k in [*first, *again, *mine]] and repeated == [True] * len(first + again) + [False] * len(mine)
            assert tokens <= budget or len([k for k in mine if not (system and k == 0)]) <= 1 and not again


def test_contract(spark, small):
    rows = {r["conv_id"]: r for r in queries.op5_chat_windows(spark, small).collect()}
    said = "\\### Assistant: </turn> ok"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[-7]["turns_sha256"] == digest(f"user\n{said}\nassistant\n{said}\n") and rows[-7]["loss_sha256"] == digest(said) and rows[-7]["loss_chars"] == len(said)
    mine, theirs = same_rows(queries.op5_chat_windows(spark, small), views(small).sql(queries.oracle_sql()["op5_chat_windows"]))
    assert mine == theirs


TEXT = st.text(alphabet="a \\<>/sl\n|é字tur", max_size=12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys<\\>\n", None]), st.one_of(st.none(), TEXT)), min_size=1, max_size=12))
def test_round_trip(spark, turns):
    rows = [(1, k, role, text) for k, (role, text) in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), budget=6, history=2)
    back = sorted((r["window"], r["place"], r["role"], r["text"]) for r in chat.read_back(made).collect())
    assert [(role, text) for _, _, role, text in back] == [(r or "", t or "") for _, _, r, t in rows]


def test_awkward_input(spark, empty):
    rows = [(1, None, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "hello " * 3000), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("clash")).withColumn("formatted", F.lit("clash")).withColumn("head", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 18000
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_native_plan(spark, small):
    plan = queries.op5_chat_windows(spark, small)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
