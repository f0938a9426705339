"""Transaction log reassembly: which changes a log undoes, by whom, and the store after every epoch of commits.

Records of a source form successive transactions. Heights turn undoing into one question: every commit, abort and
savepoint raises the level of what follows it; a record at level l has height 2l + 1, a rollback 2l, and an abort twice
the level at which its transaction began. A change is undone by the first later record of its source whose height is
lower; if there is none, the next end of a transaction is the commit that keeps it, or the log ends.

The log is cut into chunks of consecutive records. Within a chunk a sparse table of range minima over all heights and
binary lifting answer every change at once. A chunk can lower what was open before it at two records only (its first
rollback before any raise, and the abort of its first transaction), so one short row for each source and chunk stands
for it in a second sparse table over chunks, joined for each step of the lifting. Running totals over chunks, epochs and
keys are taken in groups of bounded length, and again over the groups' totals.

Input columns: at (long, the order), source, kind (commit, abort, savepoint, rollback; anything else is a change), key,
value (null: the change deletes the key). Defined results: rows without `at` are no records; a null source is a source;
a null key is a key; records with equal `at` are ordered by source and value, equal rows are records each; an empty log
has no states.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import kept

#: Records in a chunk, about; one task holds one chunk with its sparse table.
CHUNK_ROWS = 200_000
#: Rows of a key that one window looks at.
FAN = 512
COMMITS_PER_EPOCH = 16
CHANGE, COMMIT, ABORT, SAVEPOINT, ROLLBACK = range(5)
_FATES = pa.schema([("what", pa.string()), ("chunk", pa.int32()), ("source", pa.string()), *((c, pa.int64()) for c in ("at", "key", "value", "by", "level", "raises", "lower", "end")), ("end_commit", pa.bool_()), ("end_rank", pa.int64()), ("based", pa.int64())])


def first_lower(height: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked place the first later place with a lower height (the length if there is none)."""
    n = len(height)
    table = [height]
    while 2 << (len(table) - 1) <= n:
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    place, own = asked + 1, height[asked]
    for j in range(len(table) - 1, -1, -1):
        fits = place + (1 << j) <= n
        skip = fits & (table[j][np.where(fits, place, 0)] >= own)
        place = place + (skip << j)
    return place


def _last(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """At each place the value at the last flag before or at it; the first place must be flagged."""
    return values[np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))]


def _chunk(rows: pa.Table) -> pa.Table:
    """The fates of a chunk's changes, and a row for each source (what = chunk)."""
    names, source = np.unique(rows.column("source").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    at, kind = rows.column("at").to_numpy(), rows.column("code").to_numpy()
    value = pc.fill_null(rows.column("value"), np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((value, at, source))
    rows, source, at, kind = rows.take(pa.array(order)), source[order], at[order], kind[order]
    n = len(at)
    head = np.append(True, source[1:] != source[:-1])
    ends = (kind == COMMIT) | (kind == ABORT)
    raises = ends | (kind == SAVEPOINT)
    # sources follow each other at rising levels, so that none lowers another
    level = np.cumsum(raises) - raises + np.cumsum(head)
    begins = head | np.append(False, ends[:-1])
    base = _last(begins, level)
    height = np.where(kind == ROLLBACK, 2 * level, np.where(kind == ABORT, 2 * base, 2 * level + 1))
    change = np.flatnonzero(kind == CHANGE)
    lower = first_lower(height, change)
    # the next end of a transaction in the same source: the last one, seen from behind
    tail = np.append(head[1:], True)
    upcoming = np.where(ends, np.arange(n), n)
    upcoming = np.where(ends | tail, upcoming, -1)[::-1]
    upcoming = _last(upcoming >= 0, upcoming)[::-1]
    commits = np.flatnonzero(kind == COMMIT)
    rank = np.full(n + 1, -1, np.int64)
    rank[commits[np.lexsort((source[commits], at[commits]))]] = np.arange(len(commits))
    undone = lower < n
    end = upcoming[change]
    what = np.where(undone, np.where(kind[np.minimum(lower, n - 1)] == ABORT, "abort", "rollback"), np.where(end < n, "commit", "open"))
    by = np.where(undone, at[np.minimum(lower, n - 1)], rank[end])
    first = np.flatnonzero(head)
    first_of = lambda flags: np.minimum.reduceat(np.where(flags, np.arange(n), n), first)
    low, stop = first_of((kind == ROLLBACK) & (level == _last(head, level))), first_of(ends)
    total = np.add.reduceat(raises.astype(np.int64), first)
    based = np.maximum.reduceat(np.where(ends, level + 1, 0), first) - level[first]
    masked = lambda values, mask: pa.array(values, mask=mask)
    chunk, k, m = rows.column("chunk")[0].as_py(), len(change), len(first)
    here = np.minimum(stop, n - 1)
    parts = (
        {"what": what, "source": names[source[change]], "at": at[change], "key": rows.column("key").take(pa.array(change)), "value": rows.column("value").take(pa.array(change)), "by": masked(by, what == "open"), "level": level[change] - _last(head, level)[change]},
        {"what": ["chunk"] * m, "source": names[source[first]], "raises": total, "lower": masked(at[np.minimum(low, n - 1)], low >= n), "end": masked(at[here], stop >= n), "end_commit": masked(kind[here] == COMMIT, stop >= n), "end_rank": masked(rank[stop], rank[stop] < 0), "based": masked(based, based <= 0)},
        {"what": ["commits"], "level": [len(commits)]},
    )
    made = []
    for part, size in zip(parts, (k, m, 1), strict=True):
        columns = [part.get(f.name, np.full(size, chunk) if f.name == "chunk" else pa.nulls(size)) for f in _FATES]
        made.append(pa.Table.from_arrays([(c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c)).cast(f.type) for c, f in zip(columns, _FATES, strict=True)], schema=_FATES))
    return pa.concat_tables(made)


def before(df: DataFrame, keys: list[str], at: str, bound: int, **running: tuple[Callable[[Column | str], Column], str]) -> DataFrame:
    """Adds, for each name, F.sum, F.min or F.max of a column over the rows of the same keys with a lesser `at`.

    `at` is unique within keys, from 0 to below `bound`. Windows see FAN rows at most; totals of FAN consecutive places
    are run over in the same way, so the work of a task doesn't depend on how many rows a key has.
    """
    part = f"__{at}"
    df = df.withColumn(part, F.floor(F.col(at) / FAN).cast("long"))
    w = Window.partitionBy(*keys, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({name: f(c).over(w) for name, (f, c) in running.items()})
    if bound > FAN:
        totals = df.groupBy(*keys, F.col(part).alias("at")).agg(*(f(c).alias(c) for f, c in dict.fromkeys(running.values())))
        earlier = before(totals, keys, "at", math.ceil(bound / FAN), **running)
        earlier = earlier.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("at").alias("__index__"), *(F.col(n).alias(f"__{n}") for n in running))
        same = F.col("__index__") == F.col(part)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = out.join(earlier, same, "left")
        join = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.min: F.least, F.max: F.greatest}
        out = out.withColumns({name: join[f](F.col(name), F.col(f"__{name}")) for name, (f, _) in running.items()})
    return out.select(*[c for c in df.columns if c != part], *running)


def _open_fates(fates: DataFrame, chunks: int) -> DataFrame:
    """Columns source, chunk, level, what, by (place of the undoer) and commit_chunk, by_rank (of the commit) for what is open at the end of a chunk."""
    own = fates.filter("what = 'chunk'").select("source", "chunk", "raises", "lower", "end", "end_commit", "end_rank", "based")
    own = before(own.withColumn("one", F.lit(1).cast("long")), ["source"], "chunk", chunks, above=(F.sum, "raises"), place=(F.sum, "one"))
    own = own.fillna(0, ["above", "place"]).withColumn("based", F.col("above") + F.col("based"))
    own = before(own, ["source"], "chunk", chunks, base=(F.max, "based")).fillna(0, ["base"])
    own = own.withColumns({
        "least": F.least(F.when(F.col("lower").isNotNull(), 2 * F.col("above")), F.when(~F.col("end_commit"), 2 * F.col("base"))),
        "behind": chunks - 1 - F.col("chunk"), "ending": F.when(F.col("end").isNotNull(), F.struct("chunk", "end", "end_commit", "end_rank")),
    })
    own = kept(before(own, ["source"], "behind", chunks, upcoming=(F.min, "ending")))
    level = own.select("source", "place", F.coalesce("least", F.lit(2**62)).alias("least"))
    table, j = [level], 0
    while 2 << j <= chunks:
        more = table[-1].select("source", (F.col("place") - (1 << j)).alias("place"), F.col("least").alias("more"))
        table.append(kept(table[-1].join(more, ["source", "place"], "left").select("source", "place", F.least("least", "more").alias("least"))))
        j += 1
    asked = fates.filter("what = 'open'").select("source", "chunk", "level").distinct()
    asked = asked.join(own.select("source", "chunk", "above", "place", "upcoming"), ["source", "chunk"])
    asked = asked.select("source", "chunk", "level", "upcoming", (2 * (F.col("above") + F.col("level")) + 1).alias("height"), (F.col("place") + 1).alias("place"))
    for j in range(len(table) - 1, -1, -1):
        asked = asked.join(table[j], ["source", "place"], "left")
        asked = asked.withColumn("place", F.when(F.col("least") >= F.col("height"), F.col("place") + (1 << j)).otherwise(F.col("place"))).drop("least")
    found = own.select("source", "place", "lower", "end", (2 * F.col("above")).alias("low"), F.lit(True).alias("found"))
    asked = asked.join(found, ["source", "place"], "left")
    rolled = F.col("lower").isNotNull() & (F.col("low") < F.col("height"))
    committed = F.col("found").isNull() & F.col("upcoming").isNotNull()
    return asked.select(
        "source", "chunk", "level", F.when(committed, "commit").when(rolled, "rollback").otherwise("abort").alias("fate"),
        F.when(committed, F.col("upcoming.end_rank")).when(rolled, F.col("lower")).otherwise(F.col("end")).alias("fate_by"), F.when(committed, F.col("upcoming.chunk")).alias("commit_chunk"),
    )


def reassemble(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes, and the commits of each chunk.

    Changes have columns at, key, value, what (commit, abort or rollback), by (the undoer's place in the log; null at
    the log's end) and number (of the commit that keeps the change, from 0 over all sources in the order of the log).
    """
    code = F.when(F.col("kind") == "commit", COMMIT).when(F.col("kind") == "abort", ABORT).when(F.col("kind") == "savepoint", SAVEPOINT).when(F.col("kind") == "rollback", ROLLBACK).otherwise(CHANGE)
    named = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    log = kept(log.filter("at is not null").select(F.col("at").cast("long"), named.alias("source"), code.alias("code"), F.col("key").cast("long"), F.col("value").cast("long")))
    spark: SparkSession = log.sparkSession
    n = max(1, math.ceil(log.count() / CHUNK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = kept(log.repartitionByRange(n, "at", "source", "value").withColumn("chunk", F.spark_partition_id()))
    n = (dealt.agg(F.max("chunk")).first()[0] or 0) + 1
    fates = kept(dealt.groupBy("chunk").applyInArrow(_chunk, from_arrow_schema(_FATES)))
    commits = before(fates.filter("what = 'commits'").select("chunk", F.col("level").alias("commits")), [], "chunk", n, first=(F.sum, "commits")).fillna(0, ["first"])
    changes = fates.filter("what not in ('chunk', 'commits')").select("what", "chunk", "source", "level", "at", "key", "value", "by")
    waiting = changes.filter("what = 'open'").drop("what", "by").join(_open_fates(fates, n), ["source", "chunk", "level"])
    columns = ["at", "key", "value", "what", "by"]
    settled = changes.filter("what <> 'open'").select(*columns, "chunk").unionByName(waiting.select("at", "key", "value", F.col("fate").alias("what"), F.col("fate_by").alias("by"), F.col("commit_chunk").alias("chunk")))
    undone = settled.filter("what <> 'commit'").select(*columns, F.lit(None).cast("long").alias("number"))
    done = settled.filter("what = 'commit'").join(commits.select("chunk", "first"), "chunk").select("at", "key", "value", "what", F.lit(None).cast("long").alias("by"), (F.col("first") + F.col("by")).alias("number"))
    return undone.unionByName(done), commits.select("chunk", "commits")


def states(changes: DataFrame, commits: DataFrame, per_epoch: int = COMMITS_PER_EPOCH) -> DataFrame:
    """Columns epoch (from 1), n (keys stored after it) and total (of their values)."""
    epochs = math.ceil((commits.agg(F.sum("commits")).first()[0] or 0) / per_epoch)
    writes = changes.filter("what = 'commit'").withColumn("epoch", F.floor(F.col("number") / per_epoch).cast("long"))
    last = writes.groupBy("key", "epoch").agg(F.max(F.struct("number", "at", "value")).alias("last")).select("key", "epoch", F.struct("epoch", F.col("last.value").alias("value")).alias("now"))
    moved = before(last, ["key"], "epoch", epochs, past=(F.max, "now"))
    stored = lambda c: F.col(f"{c}.value").isNotNull().cast("long")
    worth = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(0))
    moved = moved.groupBy("epoch").agg(F.sum(stored("now") - stored("past")).alias("n"), F.sum(worth("now") - worth("past")).alias("total"))
    every = changes.sparkSession.range(epochs).withColumnRenamed("id", "epoch").join(moved, "epoch", "left").fillna(0, ["n", "total"])
    run = before(every, [], "epoch", max(1, epochs), n_before=(F.sum, "n"), total_before=(F.sum, "total")).fillna(0, ["n_before", "total_before"])
    return run.select((F.col("epoch") + 1).alias("epoch"), (F.col("n") + F.col("n_before")).alias("n"), (F.col("total") + F.col("total_before")).alias("total"))
