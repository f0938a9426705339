"""Scores: freshness, affinity, fit, jitter, rank, word weights, difficulty levels, placement."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fnv1a64

#: Days from 0000-12-31 to 1970-01-01, by which the day key of the jitter counts.
EPOCH_DAYS = 719163
#: Lower bounds of easy, normal, hard, harder and the levels they part.
DEFAULT_EDGES = (0.02, 0.05, 0.10, 0.18)
LEVELS = ("easy", "normal", "hard", "harder", "hardest")
#: Ranks up to which each frequency band goes.
BANDS = (1000, 3000, 5000, 10000, 20000)
CEFR = ("A1", "A2", "B1", "B2", "C1", "C2")


def freshness(age_days: Column) -> Column:
    return F.greatest(F.exp(-F.greatest(age_days, F.lit(0.0)) / 21), F.lit(0.05))


def affinity(opens: Column) -> Column:
    """log10(opens + 1), 0 without opens; it isn't clamped."""
    return F.when(opens <= 0, 0.0).otherwise(F.log(opens + 1.0) / math.log(10))


def priority_share(priority: Column, most: Column) -> Column:
    return F.when((priority <= 0) | (most <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), priority / most)))


def word_fit(words: Column) -> Column:
    return F.when(words == 0, 0.0).when(words < 150, -0.6).when(words <= 3000, 0.4).when(words <= 6000, 0.1).otherwise(-0.3)


def age_days(published: Column, fetched: Column, now: Column) -> Column:
    """Days since publication (else since fetching, else 0) in whole seconds."""
    at = F.coalesce(published, fetched)
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0, F.lit(0.0))


def day_key(now: Column) -> Column:
    return F.floor(F.unix_timestamp(now) / 86400) + EPOCH_DAYS


def jitter(id_: Column, day: Column) -> Column:
    """Between -0.3 and 0.3, the same for an id all day."""
    h = fnv1a64(F.concat(id_, F.lit(":"), day.cast("string")))
    rest = ((h["hi"] % 1000) * 296 + h["lo"]) % 1000  # 2^32 leaves 296
    return rest / 999.0 * 0.6 - 0.3


def dwell_adjustment(dwell_ms: Column, completed: Column) -> Column:
    return F.when(dwell_ms >= 300_000, F.when(completed, 0.8).otherwise(0.6)).when(dwell_ms >= 30_000, 0.2).when((dwell_ms > 0) & ~completed, -0.15).otherwise(0.0)


def rank_score(now: Column) -> Column:
    """Interest in an article from the columns of `ranking.with_affinity`."""
    fresh = freshness(age_days(F.col("published_at"), F.col("fetched_at"), now))
    shared = 1 + 0.6 * affinity(F.col("source_opens")) + 0.4 * affinity(F.col("category_opens")) + 1.5 * priority_share(F.col("source_priority"), F.col("category_priority"))
    opened = F.when(F.col("read_completed"), -0.6).otherwise(-0.25) + dwell_adjustment(F.col("dwell_ms"), F.col("read_completed"))
    return fresh * shared + F.when(F.col("liked"), 2.5).otherwise(0.0) + word_fit(F.col("word_count")) + F.when(F.col("open_count") == 0, jitter(F.col("id"), day_key(now))).otherwise(opened)


def difficulty_adjustment(level: Column) -> Column:
    return F.when(level == "normal", 0.5).when(level == "hard", 0.25).when(level == "easy", 0.1).when(level == "harder", -0.2).when(level == "hardest", -0.5).otherwise(0.0)


def level_of(score: Column, edges: tuple[float, ...] | Column = DEFAULT_EDGES) -> Column:
    """The level whose edges hold the score; null for null."""
    edge = (lambda k: edges[k]) if isinstance(edges, Column) else (lambda k: F.lit(edges[k]))
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for k in range(4):
        chain = chain.when(score < edge(k), LEVELS[k])
    return chain.otherwise(LEVELS[4])


def band_of(rank: Column) -> Column:
    """Frequency band 0 to 4 of a rank: the first of `BANDS` that holds it, the last for all beyond."""
    return F.when(rank <= BANDS[0], 0).when(rank <= BANDS[1], 1).when(rank <= BANDS[2], 2).when(rank <= BANDS[3], 3).otherwise(4)


def cefr_of(rank: Column) -> Column:
    """CEFR level by rank, 0 (A1) to 5 (C2); the lexicon is derived, so ranks stand for levels."""
    return F.when(rank <= 1000, 0).when(rank <= 3000, 1).when(rank <= 5000, 2).when(rank <= 10000, 3).when(rank <= 20000, 4).otherwise(5)


def word_weight(rank: Column, learning: Column, hard_outside: Column, known_band: int = 1, known_cefr: int = 2) -> Column:
    """1.5 for a word being learned, 1 or 0 outside the lexicon, else 1 plus half a point a step beyond what is known, 0 if known."""
    steps = F.greatest(band_of(rank) - known_band, cefr_of(rank) - known_cefr, F.lit(0))
    return F.when(learning, 1.5).when(rank.isNull(), F.when(hard_outside, 1.0).otherwise(0.0)).when(steps <= 0, 0.0).otherwise(1 + 0.5 * steps)


def sentence_factor(words_per_sentence: Column) -> Column:
    return F.when(words_per_sentence <= 0, 1.0).otherwise(F.least(F.lit(1.25), F.greatest(F.lit(0.9), 1 + 0.15 * ((words_per_sentence - 18) / 18))))


def retry_seconds(attempt: Column) -> Column:
    return F.lit(600) * F.pow(F.lit(2), F.least(attempt, F.lit(4))).cast("int")
