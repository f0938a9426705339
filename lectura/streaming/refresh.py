"""Refreshes of feeds as a stream whose state decides what the next refresh looks at.

A feed's state is the tag of its last content, the share of full texts in it, and the time of its last new article.
A fetch with the same tag is passed over unread. Otherwise the share known so far sets how long a text has to be to
count as full, and what is found sets the share for the next fetch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Entries of a fetch that are looked at.
MOST_ENTRIES = 40
STATE = "tag string, ratio double, newest timestamp, fetches long"
OUTPUT = "feed string, fetched timestamp, status string, entries long, full_texts long, bar long, ratio double, newest timestamp"
# --- fixed values: a share of full texts from here on, and characters that a text needs then ---------------------------
TRUSTED, TRUSTED_CHARS, TEASERS, TEASER_CHARS, UNKNOWN_CHARS = 0.7, 1200, 0.2, 3200, 2000


def bar_of(ratio: float) -> int:
    """Characters of a full text, by the feed's share of full texts so far (-1: not known)."""
    return TRUSTED_CHARS if ratio >= TRUSTED else TEASER_CHARS if 0 <= ratio <= TEASERS else UNKNOWN_CHARS


def _fetches(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tag, ratio, newest, n = state.get if state.exists else (None, -1.0, None, 0)
    rows, out = pd.concat(list(parts)), []
    for _, fetched in rows.groupby("fetched", sort=True):  # fetches of one feed follow each other
        at, now = fetched["fetched"].iloc[0], fetched["tag"].iloc[0]
        n += 1
        if now is not None and now == tag:
            out.append((*key, at, "unchanged", 0, 0, None, ratio, newest))
            continue
        some, bar = fetched, bar_of(ratio)
        full = int((some["chars"] >= bar).sum())
        latest = some["published"].max()
        tag, ratio = now, full / len(some)
        newest = newest if pd.isna(latest) else latest if newest is None or pd.isna(newest) else max(newest, latest)
        out.append((*key, at, "changed", len(some), full, bar, ratio, newest))
    state.update((tag, ratio, newest, n))
    frame = pd.DataFrame(out, columns=["feed", "fetched", "status", "entries", "full_texts", "bar", "ratio", "newest"])
    yield frame.astype({"bar": "Int64"}).assign(newest=pd.to_datetime(frame["newest"]))


def refreshed(entries: DataFrame) -> DataFrame:
    """One row for each fetch of a feed, from its entries (feed, fetched, tag, place, chars, published) as a stream.

    Places count from 0, and MOST_ENTRIES of a fetch are looked at. All entries of a fetch come in one batch, and fetches of a feed in their order. A null tag is never the same. A
    null feed is a feed; entries without a length count as empty.
    """
    few = entries.select("feed", "fetched", "tag", "place", "chars", "published").filter(F.col("place") < MOST_ENTRIES)
    return few.groupBy("feed").applyInPandasWithState(_fetches, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
