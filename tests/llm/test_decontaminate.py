import random

from pyspark.sql import functions as F

from lectura.llm import decontaminate as dec
from lectura.llm import queries

ITEM = "On Monday the farmer Tom carries 12 kg of apples and 5 kg of plums to the market in town, and then Tom returns with 12 empty baskets."


def found(spark, docs, items=((1, ITEM),), **kwargs):
    d = spark.createDataFrame(list(docs), "doc_id long, text string")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in dec.contaminated(d, i, **kwargs).collect()}


def test_templates(spark):
    marked = spark.range(1).select(dec.tokens(F.lit("We met Anna, 3.5 km away; 20% of IT at 7 o'clock")).alias("t")).first()["t"]
    kinds = [t[0] if t[0] in (dec.NUMBER, dec.NAME, dec.UNIT) else t for t in marked]
    assert kinds == [dec.NAME, "met", dec.NAME, dec.NUMBER, dec.UNIT, "away", dec.NUMBER, dec.UNIT, "of", dec.NAME, "at", dec.NUMBER, "o", "clock"]


def test_reparameterised_questions(spark):
    new = ITEM.replace("Tom", "Ann").replace("12", "40").replace("5 kg", "9 kg")
    broken = ITEM.replace("Tom carries", "Ann carries").replace("12 empty", "40 empty")
    rows = found(spark, [(1, "before. " + ITEM + " after"), (2, "some words here, then " + new), (3, "x " + broken), (4, "the farmer carries apples and plums to the market"), (5, None), (6, ""), (7, ITEM.upper())])
    assert (1, 1) in rows and rows[1, 1]["n_changed"] == 0 and (2, 1) in rows and rows[2, 1]["n_changed"] > 2
    assert (3, 1) not in rows or rows[3, 1]["n_windows"] < rows[1, 1]["n_windows"]
    assert not {k for k in rows if k[0] in (4, 5, 6)}


def test_short_items_and_weak_ones(spark):
    rows = found(spark, [(1, "so the answer is forty two apples today"), (2, "1 2 3 4 5 6 7 8 9 10 11 12")], [(1, "the answer is forty"), (2, "1 2 3 4 5 6 7 8 9 10 11"), (3, "Ok"), (4, None)])
    assert set(rows) == {(1, 1)}


def test_same_as_brute_force(spark, small):
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_templates(spark, small).collect()}
    docs, items = ({r[0]: " ".join(r[1].lower().split()) for r in spark.read.parquet(f"{small}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    whole = {(d, i) for d, x in docs.items() for i, y in items.items() if y[10:] in x}
    import re

    windows = {}
    for i, y in items.items():
        w = re.findall(r"[^\W\d_]+", y)
        for k in range(max(1, len(w) - 5)):
            windows.setdefault(tuple(w[k : k + 6]), set()).add(i)
    some = set()
    for d, x in docs.items():
        w = re.findall(r"[^\W\d_]+", x)
        some |= {(d, i) for k in range(len(w)) for i in windows.get(tuple(w[k : k + 6]), ())}
    assert whole and whole <= got <= some


def test_long_benchmark_goes_without_broadcast(spark, monkeypatch):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(20))) for k in range(10)]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(40)) + " " + items[k % 10][1]) for k in range(20)]
    wanted = set(found(spark, docs, items))
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", 0)
    assert set(found(spark, docs, items)) == wanted == {(k, k % 10) for k in range(20)}


def test_native_plan(spark, small):
    plan = queries.op8_templates(spark, small)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_awkward_input(spark, awkward, empty):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog the quick brown fox"), (None, "x"), (2, None)], "item_id long, text string")
    rows = dec.contaminated(awkward, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (7, 1)} and len(rows) == 2
    left = dec.drop_contaminated(awkward, items)
    assert left.columns == awkward.columns and left.count() == 8  # without the three rows of ids 1 and 7, and the text x
    assert dec.contaminated(empty, items).count() == 0 and dec.contaminated(awkward, items.limit(0)).count() == 0 and dec.drop_contaminated(awkward, items.limit(0)).count() == 12
