"""Title deduplication: exact and by similarity, without comparing all pairs."""

from __future__ import annotations

import math
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, title_tokens

LEAST_TOKENS, THRESHOLD = 8, 0.85


def similar_pairs(titles: DataFrame, key: str = "id", tokens: str = "tokens", threshold: float = THRESHOLD, least: int = LEAST_TOKENS) -> DataFrame:
    """Pairs (a < b) of rows with distinct token sets whose similarity reaches the threshold, by prefix filtering.

    Sets are ordered by rising frequency of their tokens; two similar sets share a token among their first
    n - ceil(t n) + 1, so only rows that meet there, and whose sizes allow it, are compared. Rows with one and the same
    token set are one node: `a` and `b` are the least keys of theirs, and no pairs of copies are made.
    """
    sets = titles.filter(F.size(tokens) >= least).withColumn("set", F.array_sort(F.array_distinct(tokens)))
    nodes = sets.groupBy("set").agg(F.min(key).alias("node"))
    words = nodes.select("node", F.explode("set").alias("word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ordered = words.join(frequency, "word").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))  # as long as a title
    n = F.size("w")
    prefix = F.slice("w", F.lit(1), n - F.ceil(n * threshold).cast("int") + 1)
    keyed = ordered.select("node", F.col("w.word").alias("words"), n.alias("n"), F.explode(F.transform(prefix, lambda x: x["word"])).alias("word"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (F.col("a.word") == F.col("b.word")) & (F.col("a.node") < F.col("b.node")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))
    met = a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), jaccard(F.col("a.words"), F.col("b.words")).alias("similarity"))
    return met.filter(F.col("similarity") >= threshold).dropDuplicates(["a", "b"])


def members(titles: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """key and node (the least key with the same token set)."""
    return titles.withColumn("node", F.min(key).over(Window.partitionBy(F.array_sort(F.array_distinct(tokens))))).select(key, "node")


def greedy_kept(titles: DataFrame, title: str = "title", key: str = "id", order: str = "number") -> DataFrame:
    """Keys of the rows that stay if, in order, each is dropped that duplicates one kept before it.

    Rows with one token set share their fate but for the first, so sets are nodes; short titles only fall to exact
    copies, empty ones never. No group of similar titles is ever gathered. The order must be unique.
    """
    rows = titles.select(F.col(key).alias("key"), F.col(order).alias("o"), title_tokens(F.col(title)).alias("tokens"))
    long = F.size("tokens") >= LEAST_TOKENS
    empty = rows.filter(F.size("tokens") == 0).select("key")
    short = rows.filter(~long & (F.size("tokens") > 0)).groupBy("tokens").agg(F.min_by("key", "o").alias("key")).select("key")
    sets = rows.filter(long).groupBy(F.array_sort(F.array_distinct("tokens")).alias("set")).agg(F.min_by(F.struct("key", "tokens"), "o").alias("first"), F.min("o").alias("o"))
    nodes = _cut(sets.select("o", "first.key", "first.tokens"))
    links = _cut(similar_pairs(nodes.select(F.col("o").alias("id"), "tokens")).select("a", "b"))
    gone = first_independent(links)
    kept = nodes.join(gone, "o", "left_anti").select("key")
    return kept.unionByName(short).unionByName(empty).withColumnRenamed("key", key)


def first_independent(links: DataFrame) -> DataFrame:
    """Column o: the nodes that go if, in order, each goes that has a link to an earlier one that stays.

    `links` has columns a < b, each once. Rounds decide all nodes without an undecided earlier neighbour (they stay) and
    what these have links to. A node with a single undecided earlier neighbour does the opposite of what that does: such
    chains are followed to their beginnings by doubling, so a chain of any length takes one round of as many joins as
    its length has binary digits. Links of decided nodes go after each round.
    """
    links = _cut(links.select("a", "b"))
    gone: list[DataFrame] = []
    while not links.isEmpty():
        earlier = _cut(links.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")))
        begins = links.join(earlier.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("o")).distinct()
        # node, the node that its fate hangs on, and whether it does the opposite of that
        chain = _cut(earlier.filter("n = 1").select(F.col("b").alias("o"), F.col("a").alias("on"), F.lit(True).alias("other")))
        while True:
            above = chain.select(F.col("o").alias("on"), F.col("on").alias("on_"), F.col("other").alias("other_"))
            longer = chain.join(above, "on", "left")
            longer = _cut(longer.select("o", F.coalesce("on_", "on").alias("on"), (F.col("other") != F.coalesce("other_", F.lit(False))).alias("other"), F.col("on_").isNotNull().alias("moved")))
            chain = longer.drop("moved")
            if longer.filter("moved").isEmpty():
                break
        known = chain.join(begins.select(F.col("o").alias("on")), "on", "left_semi")
        stay = begins.unionByName(known.filter("not other").select("o"))
        fall = known.filter("other").select("o").unionByName(links.join(stay.select(F.col("o").alias("a")), "a", "left_semi").select(F.col("b").alias("o"))).distinct()
        stay, fall = _cut(stay), _cut(fall)
        gone.append(fall)
        decided = stay.unionByName(fall)
        links = links.join(decided.select(F.col("o").alias("b")), "b", "left_anti").join(decided.select(F.col("o").alias("a")), "a", "left_anti")
        links = _cut(links.select("a", "b"))
    return reduce(DataFrame.unionByName, gone) if gone else links.select(F.col("b").alias("o"))


def _cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the checkpoint folder of the session."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="lectura-")


def prefix_length(n: int, threshold: float = THRESHOLD) -> int:
    """How many of n ordered tokens two similar sets share one of."""
    return n - math.ceil(threshold * n) + 1
