"""The outlier verdicts against a plain numpy version, and its determinants against random starts."""

import math
import random

import numpy as np

from lectura.llm import outliers
from test_outliers import counts

FLOORS = np.array(outliers.FLOORS) ** 2
NOTHING = (np.zeros(5), np.zeros((5, 5)), 0.0)


def vector(text):
    n, chars, symbols, lines, repeats = counts(text)
    return [math.log1p(n), math.log((chars + 1) / (n + 1)), math.sqrt(symbols / (chars + 1)), math.sqrt(lines / n), math.sqrt(repeats / n)]


def quantile(bins, share):
    """The bin in which the share ends, and how much of it is needed."""
    found, n = np.unique(bins, return_counts=True)
    to = n.cumsum()
    k = int(np.argmax(to >= share * len(bins)))
    return found[k], (share * len(bins) - to[k]) / n[k] + 1


def median(x):
    return np.array([(quantile(np.floor(c * outliers.FINE), 0.5)[0] + 0.5) / outliers.FINE for c in x.T])


def distances(x, m, c):
    return np.einsum("ij,ij->i", x - m, np.linalg.solve(c, (x - m).T).T)


def estimate(x, w, prior, floors, scale=1.0):
    m = np.average(x, axis=0, weights=w)
    s = (x - m).T @ ((x - m) * w[:, None]) / w.sum() * scale + np.diag(floors * FLOORS)
    return m, (w.sum() * s + prior[2] * prior[1]) / (w.sum() + prior[2])


def concentrate(x, m, c, prior, floors):
    bins = np.floor(np.log(distances(x, m, c) + 1e-9) * outliers.FINE_DISTANCE)
    most, part = quantile(bins, outliers.CORE)
    return estimate(x, np.where(bins < most, 1.0, np.where(bins == most, part, 0.0)), prior, floors)


def log_det(c):
    return np.linalg.slogdet(c)[1]


def starts(x):
    m = median(x)
    s = np.maximum(1.4826 * median(np.abs(x - m)) - 1.4826 * 0.5 / outliers.FINE, np.array(outliers.FLOORS))
    z = (x - m) / s
    length = np.sqrt((z * z).sum(1))
    u = z / np.where(length > 0, length, 1)[:, None]
    for q in (None, np.cov(np.tanh(z).T, bias=True), u.T @ u):
        r = np.zeros((5, 5))
        if q is not None:
            across = np.sqrt(np.outer(np.diag(q), np.diag(q)))
            r = np.where(across > 0, q / np.where(across > 0, across, 1), 0)
        c = r * np.outer(s, s)
        c[np.diag_indices(5)] = s**2 + FLOORS
        yield m, c


def core(x, prior=NOTHING, floors=1.0):
    tried = []
    for m, c in starts(x):
        for _ in range(outliers.TRIED):
            m, c = concentrate(x, m, c, prior, floors)
        tried.append((m, c))
    m, c = min(tried, key=lambda e: log_det(e[1]))
    for _ in range(60):
        after = concentrate(x, m, c, prior, floors)
        if log_det(after[1]) >= log_det(c):
            break
        m, c = after
    return m, c


def final(x, prior=NOTHING, floors=1.0):
    m, c = core(x, prior, floors)
    d2 = distances(x, m, c)
    middle = quantile(np.floor(np.log(d2 + 1e-9) * outliers.FINE_DISTANCE), 0.5)[0]
    scale = max(1.0, math.exp((middle + 0.5) / outliers.FINE_DISTANCE) / outliers.MEDIAN)
    usual = x[d2 <= outliers.USUAL * scale]
    m, c = estimate(usual, np.ones(len(usual)), prior, floors, scale)
    return (len(usual) * m + prior[2] * prior[0]) / (len(usual) + prior[2]), c


def corpus():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    rows = []
    for lang, source, n, junk in (("en", "a", 130, 25), ("en", "b", 40, 9), ("en", "c", 1, 1), ("de", "a", 70, 0), ("fr", None, 2, 0), (None, "a", 1, 0)):
        for k in range(n + junk):
            text = [rnd.choice(words) for _ in range(int(math.exp(rnd.uniform(4.2, 6.5))))]
            if rnd.random() < 0.3:
                text += rnd.sample(text, 3) + text[5:11]
            if rnd.random() < 0.2:
                text[7] += "#&"
            if k >= n:
                text = [t + rnd.choice("#*$%&|") * 3 for t in text] if k % 2 else text[:40] + ["\nsame old line\n"] * 20
            rows.append((len(rows), " ".join(text), lang, source, k >= n))
    return rows


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(outliers, "SETTLED", 0.0)
    monkeypatch.setattr(outliers, "STEPS", 60)
    rows = corpus()
    frame = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in outliers.reject_outliers(frame).collect()}
    passed = [r for r in rows if not got[r[0]]["base_failed"]]
    assert len(got) == len(rows) and len(passed) > 250
    for lang in {r[2] for r in passed}:
        of = [r for r in passed if r[2] == lang]
        whole = final(np.array([vector(r[1]) for r in of]), floors=1 + outliers.PRIOR / len(of))
        for source in {r[3] for r in of}:
            some = [r for r in of if r[3] == source]
            x = np.array([vector(r[1]) for r in some])
            for r, d2 in zip(some, distances(x, *final(x, (*whole, outliers.PRIOR))), strict=True):
                assert math.isclose(got[r[0]]["d2"], d2, rel_tol=1e-6, abs_tol=1e-9), (lang, source)
                assert got[r[0]]["kept"] == (d2 <= outliers.CUTOFF)
    assert all(got[r[0]]["kept"] for r in rows if not r[4]) and not any(got[r[0]]["kept"] for r in rows if r[4] and r[3] != "c")


def test_determinant_is_about_the_least():
    x = np.array([vector(r[1]) for r in corpus() if r[2:4] == ("en", "a")])
    found, rnd = log_det(core(x)[1]), np.random.default_rng(3)
    for _ in range(100):
        m, c = estimate(x[rnd.choice(len(x), 6, replace=False)], np.ones(6), NOTHING, 1.0)
        for _ in range(60):
            m, c = concentrate(x, m, c, NOTHING, 1.0)
        assert found <= log_det(c) + 0.02
