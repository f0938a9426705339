"""Language identification by a string kernel.

A text's blended spectrum is the set of its n-grams of one to `LONGEST` characters, each run of anything but letters
being one space, hashed to `WIDTH` places. The kernel of two texts is |A and B| / sqrt(|A| |B|) (presence, not counts).
Nystroem landmarks stand for the training texts, and one-versus-rest kernel ridge regression gives each language a
function of the kernels with the landmarks. As those are linear in a text's presence vector, batches of texts are
scored by one matrix product of presences with the folded landmark weights.

Fitting takes a bounded sample of labelled rows: at most `SAMPLE` texts (whole ones) of each of at most `LANGUAGES`
languages, those with the least hashed ids, so rows are chosen alike at every size. Every text is then scored whole.

The score is a share among the learned languages, so it says nothing about texts in none of them. For that, `known` is
the share of a text's n-grams that at least two training texts of its predicted language hold (one, of a language with
fewer than `FEW` texts); it doesn't depend on how many languages are learned.

Defined results: a text that is null or has no letter is `und` with score 0; with no labelled text at all everything is
`und`; equal scores go to the first language in order; repeated rows get equal results; other columns pass through
`identify`, and one named like an output is replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices

UNKNOWN = "und"
LONGEST, WIDTH = 3, 1 << 15
SAMPLE, LANGUAGES, LANDMARKS, RIDGE, SHARPNESS = 300, 200, 192, 1e-3, 4.0
#: Training texts of a language below which one text is enough to make an n-gram known.
FEW = 100
#: Texts whose presences are scored by one product.
ROWS = 64

_letter: list[np.ndarray] = []


def _spectrum(text: str, longest: int = LONGEST) -> np.ndarray | None:
    """The places (with repeats) of a text's n-grams; None without letters."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter[0][codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes[letter | np.append(True, letter[:-1])], [np.uint32(32)]]).astype(np.uint32)
    found, h = [], np.zeros(codes.size, np.uint32)
    for n in range(1, longest + 1):
        h = (h[: codes.size - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
        found.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(WIDTH - 1))
    return np.concatenate(found).astype(np.int64)


def _presences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 matrix of the texts' n-grams, and the norm of each row (0 without letters)."""
    matrix = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(matrix, texts, strict=True):
        if text and (places := _spectrum(text)) is not None:
            row[places] = 1
    return matrix, np.sqrt(matrix.sum(1, dtype=np.float64))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # WIDTH x languages: the landmarks' presences folded with the regressions
    bias: np.ndarray
    known: np.ndarray  # WIDTH x languages: 1 for the places of each language's known n-grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None], with_known: bool = False) -> tuple[list[str], list[float], list[float]]:
        """Language and score of each text, and its share of known n-grams (0 without letters; only if asked for)."""
        names, scores, known = [], [], []
        for at in range(0, len(texts), ROWS):
            matrix, norm = _presences(texts[at : at + ROWS])
            if not self.languages:
                names += [UNKNOWN] * len(norm)
                scores += [0.0] * len(norm)
                known += [0.0] * len(norm) if with_known else []
                continue
            margin = (matrix @ self.weights) / np.maximum(norm, 1)[:, None] + self.bias
            share = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
            best = margin.argmax(1)
            sure = (1 / share.sum(1)).round(6)
            names += [self.languages[b] if n else UNKNOWN for b, n in zip(best, norm, strict=True)]
            scores += [float(s) if n else 0.0 for s, n in zip(sure, norm, strict=True)]
            if with_known:
                held = (matrix @ self.known)[np.arange(len(norm)), best] / np.maximum(norm**2, 1)
                known += held.round(6).tolist()
        return names, scores, known


def train(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fits the model; landmarks are taken evenly from the languages, in the order of the texts."""
    keep = [k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    texts, labels = [texts[k] for k in keep], [labels[k] for k in keep]
    names = sorted(set(labels))
    if not names:
        return LanguageModel((), np.zeros((WIDTH, 0), np.float32), np.zeros(0), np.zeros((WIDTH, 0), np.float32))
    each = max(1, landmarks // len(names))
    chosen = [k for name in names for k in [j for j, x in enumerate(labels) if x == name][:each]]
    marks, mark_norm = _presences([texts[k] for k in chosen])
    marks /= mark_norm[:, None].astype(np.float32)
    inner = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    strong = value > 1e-6 * value.max()
    root = vector[:, strong] / np.sqrt(value[strong])
    parts = []
    of = np.array(labels)[:, None] == np.array(names)
    holders = np.zeros((WIDTH, len(names)), np.float32)
    for at in range(0, len(texts), ROWS):
        matrix, norm = _presences(texts[at : at + ROWS])
        holders += matrix.T @ of[at : at + ROWS].astype(np.float32)
        parts.append((matrix @ marks.T).astype(np.float64) / norm[:, None])
    features = np.concatenate(parts) @ root
    target = np.where(of, 1.0, -1.0)
    mean, bias = features.mean(0), target.mean(0)
    centered = features - mean
    solved = np.linalg.solve(centered.T @ centered + ridge * len(texts) * np.eye(centered.shape[1]), centered.T @ (target - bias))
    folded = root @ solved
    return LanguageModel(tuple(names), (marks.T @ folded).astype(np.float32), bias - mean @ solved, (holders >= np.where(of.sum(0) < FEW, 1, 2)).astype(np.float32))


def sample_labelled(df: DataFrame, text: str, lang: str, order: Column, sample: int = SAMPLE, languages: int = LANGUAGES) -> tuple[list[str], list[str]]:
    """At most `sample` texts with letters of each of the most frequent languages: those with the least `order` (a long)."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(order, F.lit(1 << 40)).alias("o")).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return [], []
    # twice as many as wanted are let through, so that only a bounded number of texts is sorted
    bounds = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 2 * sample / r["n"] + 20 / r["n"]) * (1 << 40))))))
    few = rows.filter(F.col("o") < bounds[F.col("lang")]).filter(F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))
    found = few.withColumn("r", rank).filter(F.col("r") <= sample).orderBy("lang", "r").select("lang", "text").collect()
    return [r["text"] for r in found], [r["lang"] for r in found]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **kwargs) -> LanguageModel:
    """Trains on a bounded sample of the rows with a language."""
    return train(*sample_labelled(df, text, lang, F.xxhash64(doc_id), **kwargs))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", predicted: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """Adds the language of each text (of those learned, or `und`), a score from 0 to 1 and, if named, `known`. Only `text` is looked at."""
    added = [predicted, score, *([known] if known else [])]
    df = df.drop(*added)
    sent = bounded_batches(df).sparkContext.broadcast(model)  # WIDTH x languages numbers, whatever the corpus
    schema = T.StructType([*df.schema.fields, T.StructField(predicted, T.StringType(), False), *(T.StructField(c, T.DoubleType(), False) for c in added[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            names, *numbers = sent.value.judge(part.column(text).to_pylist(), bool(known))
            numbers = [pa.array(x, pa.float64()) for x in numbers[: len(added) - 1]]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), *numbers], names=[*part.schema.names, *added])

    return df.mapInArrow(run, schema)
