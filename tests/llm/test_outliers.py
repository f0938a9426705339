import random
import re
from collections import Counter

from lectura.llm import outliers


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(spark, small):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(40))) for _ in range(40)] + ["a b c a b c", "a a a a a", "x\n\nx\n \nx y\n", "é#|<字> \x0b z"]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = outliers.base_counts(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == counts(texts[r["doc_id"]])


def test_verdicts(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    clean = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 600))) for _ in range(150)]
    junk = [" ".join(rnd.choice(vocabulary) + rnd.choice("#*$%&|") * 3 for _ in range(200)) for _ in range(12)]
    rows = [(k, t, "en", "s") for k, t in enumerate(clean + junk)] + [(1000 + k, t, "fr", "few") for k, t in enumerate(junk)] + [(2000, "short", "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in outliers.reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(150)) and not any(got[150 + k] for k in range(12)) and not got[2000]
    assert all(got[1000 + k] for k in range(12))  # too few of their language to tell


def test_native_plan(spark, small):
    from lectura.llm import queries

    plan = queries.op4_outliers(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_awkward_input(awkward, empty):
    rows = outliers.reject_outliers(awkward).collect()
    assert len(rows) == 12 and sum(r["kept"] for r in rows) <= 2
    assert outliers.reject_outliers(empty).count() == 0
