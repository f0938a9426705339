"""The whole operator against a plain matcher, with copies and re-parameterised copies in four languages."""

import random

import regex

from lectura.llm import decontaminate as dec

ITEMS = (
    "On Monday the farmer Tom carries 12 kg of apples and 5 kg of plums to the market in town, and then Tom returns with 12 empty baskets.",
    "Tom has 5 apples. He gives 2 apples to Ann and then buys 7 more at the shop. How many apples does he have now?",
    "Am Montag trägt der Bauer Tom 12 kg Äpfel und 5 kg Pflaumen zum Markt in der Stadt.",
    "Le lundi, Marie achète 3 kg de pommes et 2 kg de poires au marché, puis elle rentre avec 40 euros dans sa poche.",
    "El lunes el granjero Juan lleva 12 kg de manzanas y 5 kg de ciruelas al mercado del pueblo, y luego vuelve con 12 cestas.",
    "Solve 3x + 7 = 22 for x.",
    "the answer is forty",
)
NAMES = ("Tom", "Ann", "Marie", "Juan", "Otto", "Zoe")


def tokens(text):
    unit = "|".join(sorted(dec.UNITS, key=len, reverse=True))
    out, last = [], None
    for m in regex.finditer(rf"\p{{N}}+(?:[.,:/]\p{{N}}+)*|%|[\p{{L}}\p{{M}}]+", text):
        t, behind = m[0], last is not None and last[0] and regex.fullmatch(r"\s?", text[last[1] : m.start()]) is not None
        if t[0].isnumeric():
            out.append(dec.NUMBER + t.lower())
            last = (True, m.end())
            continue
        if behind and (t == "%" or regex.fullmatch(f"(?i:{unit})", t)):
            out.append(dec.UNIT + t.lower())
        elif t != "%":
            out.append((dec.NAME if regex.match(r"\p{Lu}", t) else "") + t.lower())
        last = (False, m.end())
    return out


def is_word(t):
    return t[0] not in (dec.NUMBER, dec.NAME, dec.UNIT)


def matches(doc, item):
    d, i = tokens(doc), tokens(item)
    size = min(dec.WINDOW, len(i))
    form = lambda ts: [t if is_word(t) else t[0] for t in ts]
    bare = lambda ts: [t.lstrip(dec.NUMBER + dec.NAME + dec.UNIT) for t in ts]
    of = {}
    for k in range(len(i) - size + 1 if i else 0):
        w = i[k : k + size]
        words = sum(map(is_word, w))
        if not all(t[0] == dec.NUMBER for t in w):
            needed = dec.LITERALS if size == dec.WINDOW else -(-2 * size // 3)
            of[k] = words >= needed or size < dec.WINDOW and words >= dec.WHOLE and 3 * words >= size
    runs, dense = {}, not any(of.values())
    for k, strong in of.items():
        w = i[k : k + size]
        for at in range(len(d) - size + 1):
            v = d[at : at + size]
            if bare(v) == bare(w):
                runs.setdefault(at - k, []).append((k, strong, w, w))
            elif (strong or dense and any(map(is_word, w))) and form(v) == form(w):
                runs.setdefault(at - k, []).append((k, strong, w, v))
    best = 0
    for run in runs.values():
        slots = lambda some: {(a, b) for _, _, w, v in some for a, b in zip(w, v) if not is_word(a)}
        one = lambda pairs: len(pairs) == len({a for a, _ in pairs})
        firm = [r for r in run if r[1]]
        literals = {k + j for k, _, w, _ in run for j, t in enumerate(w) if is_word(t)}
        if one(slots(run)) and (firm or dense and len(literals) >= dec.LITERALS):
            best = max(best, len(run))
        else:
            best = max(best, sum(w == v for _, _, w, v in run), len(firm) if one(slots(firm)) else 0)
    return best


def planted(rnd):
    filler = "so we went on and on, 3 times; Then nothing else was said about it.".split()
    around = lambda: " ".join(rnd.choice(filler) for _ in range(rnd.randrange(12)))
    docs = []
    for item in ITEMS:
        changed = regex.sub(r"\d+", lambda m: str(int(m[0]) + 11), item)
        renamed = regex.sub(r"\b(?:" + "|".join(NAMES) + r")\b", lambda m: NAMES[(NAMES.index(m[0]) + 1) % 6], changed)
        broken = regex.sub(r"\d+", lambda m: str(rnd.randrange(100, 999)), item)
        cut = " ".join(item.split()[3:-3])
        docs += [f"{around()} {t} {around()}" for t in (item, changed, renamed, broken, cut, item.lower(), item.replace("kg", "miles"))]
    return docs


def test_same_as_a_plain_matcher(spark):
    docs = planted(random.Random(5))
    wanted = {(d, i): n for d, x in enumerate(docs) for i, y in enumerate(ITEMS) if (n := matches(x, y))}
    rows = dec.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_windows"] for r in rows} == wanted
    for k in range(len(ITEMS)):
        assert {(7 * k, k), (7 * k + 5, k)} <= set(wanted)  # word for word, in each language, whatever the case
    assert {(7 * k + c, k) for k in range(5) for c in (1, 2)} <= set(wanted)  # other numbers, other names too


def test_rows_and_items_without_ids(spark):
    docs = spark.createDataFrame([(None, "x. " + ITEMS[0]), (None, "nothing of the kind"), (1, ITEMS[1]), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEMS[0]), (3, ITEMS[1]), (None, None)], "item_id long, text string")
    left = dec.drop_contaminated(docs.selectExpr("*", "'a' as found_id", "1 as row_number"), items)
    assert sorted(r["text"] for r in left.collect()) == ["clean text", "nothing of the kind"]
