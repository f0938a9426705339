"""Ranked lexical search over a bit-sliced impact index.

The impact of a term in a document is a whole number. Documents are indexed in blocks, in each of which a term has one
bitmap for each bit of its impacts. Scores of all documents of a block come from adding the bitmaps of an item's terms
with carries, bit by bit; the best are found from the most significant bitmap down, by keeping, at each bit, the
candidates that have it for as long as enough do. Tasks keep the best of their blocks, a window ranks what is left.

Queries go in passes of bounded bytes, so that what executors get of them, their terms and these terms' frequencies, is
bounded; each pass searches all documents. Counts cover all documents.

Defined results: null and empty texts have no terms and are never found; every row is a document, also with a repeated
or null id (null ids come first among equal scores); repeated items count once; items without known terms have no rows;
ties go by id; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, kept, slices, texts

#: Bytes of queries in one pass over the documents.
PASS_BYTES = 8 << 20
#: Documents of a block, and bytes of bitmaps that a task keeps for its next queries.
BLOCK_DOCS, BITMAP_BYTES = 8192, 128 << 20
#: Saturation and length normalisation, as whole numbers: tf * SCALE div (1000 * tf + SATURATION * m).
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75

_terms = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return _terms(text.lower())


def weight(n_docs: int, df: int) -> int:
    """How much a term of `df` documents weighs among `n_docs`."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impacts of terms that occur tf times in documents of n terms."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // max(n_terms, 1)
    return weights * ((SCALE * tf) // (1000 * tf + SATURATION * m))


def postings(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """Columns doc, n (its terms with repeats), terms (places in the vocabulary) and tfs."""
    schema = T.StructType([T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(vocabulary.value)}
        for part in slices(batches, text):
            n, terms, tfs = [], [], []
            for raw in texts(part, text).cast(pa.large_binary()).to_pylist():
                found = terms_of(raw)
                counts = Counter(found)
                own = counts.keys() & known.keys()
                n.append(len(found))
                terms.append([known[t] for t in own])
                tfs.append([counts[t] for t in own])
            yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc", "n", "terms", "tfs"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


class Block:
    """The bitmaps of a block: documents are bits, in the order of their ids."""

    def __init__(self, size: int, terms: np.ndarray, places: np.ndarray, values: np.ndarray):
        self.words = (size + 63) // 64
        order = np.argsort(terms, kind="stable")
        self.terms, self.places, self.values = terms[order], places[order], values[order]
        self.made: dict[int, np.ndarray] = {}
        self.held = 0

    def slices(self, term: int) -> np.ndarray:
        """A row of bits for each bit of the term's impacts, the least significant first; no rows if it is absent."""
        if term in self.made:
            return self.made[term]
        lo, hi = np.searchsorted(self.terms, [term, term + 1])
        places, values = self.places[lo:hi], self.values[lo:hi]
        depth = int(values.max()).bit_length() if hi > lo else 0
        bit, which = np.nonzero((values >> np.arange(depth)[:, None]) & 1)
        at = bit * self.words * 64 + places[which]
        packed = np.bincount(at >> 3, 1 << (at & 7), depth * self.words * 8).astype(np.uint8)
        found = packed.view("<u8").reshape(depth, self.words)
        if self.held > BITMAP_BYTES:
            self.made, self.held = {}, 0
        self.made[term] = found
        self.held += found.nbytes
        return found

    def add(self, total: list[np.ndarray], more: np.ndarray, shift: int) -> None:
        """Adds a term's bitmaps, times 2^shift, into the total's."""
        carry, j = None, shift
        while j < shift + len(more) or carry is not None:
            if j >= len(total):
                total.extend(np.zeros(self.words, np.uint64) for _ in range(j + 1 - len(total)))
            own, new = total[j], more[j - shift] if j < shift + len(more) else None
            if new is None:
                total[j], carry = own ^ carry, own & carry
            elif carry is None:
                total[j], carry = own ^ new, own & new
            else:
                both = own ^ new
                total[j], carry = both ^ carry, (own & new) | (both & carry)
            if not carry.any():
                carry = None
            j += 1

    def best(self, query: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """Place and score of the k best documents above 0 of (term, times) pairs; the first of equal ones."""
        total: list[np.ndarray] = []
        for term, times in query:
            if len(more := self.slices(term)):
                for shift in range(times.bit_length()):
                    if times >> shift & 1:
                        self.add(total, more, shift)
        if not total:
            return []
        sure, open_ = np.zeros(self.words, np.uint64), np.bitwise_or.reduce(total)
        for bits in reversed(total):
            have = open_ & bits
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(have).sum())
            if n >= k:
                open_ = have
            else:
                sure, open_ = sure | have, open_ & ~bits
            if n == k:
                break
        at = self.on(sure)
        at = np.sort(np.concatenate([at, self.on(open_)[: k - len(at)]]))
        score = sum(((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j for j, bits in enumerate(total))
        return list(zip(at.tolist(), score.tolist(), strict=True))

    @staticmethod
    def on(bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def _block(rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[Block, pa.Array]:
    """A block of postings, and the ids of its documents."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc", "ascending")], null_placement="at_start")).combine_chunks()
    whole = [rows.column(c).combine_chunks() for c in ("terms", "tfs")]
    terms, tfs = (c.flatten().to_numpy().astype(np.int64) for c in whole)
    places = np.repeat(np.arange(len(rows)), pc.list_value_length(whole[0]).to_numpy(zero_copy_only=False))
    n = rows.column("n").to_numpy()[places]
    return Block(len(rows), terms, places, impacts(tfs, n, weights[terms], n_docs, n_terms)), rows.column("doc").combine_chunks()


def _pass(docs: DataFrame, queries: list[tuple[int, bytes]], k: int, doc_id: str, text: str) -> DataFrame:
    """Columns query, doc and score: the k best of each task for each of a bounded number of queries."""
    spark = bounded_batches(docs)
    counted = [(i, Counter(terms_of(raw))) for i, raw in queries]
    vocabulary = sorted({t for _, c in counted for t in c})
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = spark.sparkContext.broadcast([(i, [(place[t], times) for t, times in sorted(c.items())]) for i, c in counted if c])
    found = kept(postings(docs, spark.sparkContext.broadcast(vocabulary), doc_id, text))
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the pass at most
        weights[term] = weight(n_docs, df)
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}

        def search(held: list[pa.RecordBatch]) -> None:
            block, ids = _block(pa.Table.from_batches(held), sent.value, n_docs, n_terms)
            for i, query in asked.value:
                if own := block.best(query, k):
                    names = ids.take(pa.array([at for at, _ in own])).to_pylist()
                    merged = best.get(i, []) + [(-score, name is not None, name, score) for name, (_, score) in zip(names, own, strict=True)]
                    best[i] = sorted(merged)[:k] if len(merged) > k else merged

        held, size = [], 0
        for batch in batches:
            at = 0
            while batch.num_rows - at > BLOCK_DOCS - size:
                held.append(batch.slice(at, BLOCK_DOCS - size))
                at += BLOCK_DOCS - size
                search(held)
                held, size = [], 0
            held.append(batch.slice(at))
            size += batch.num_rows - at
        if size:
            search(held)
        rows = [(i, name, score) for i, own in best.items() for _, _, name, score in own]
        if rows:
            query, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], ["query", "doc", "score"])

    schema = T.StructType([T.StructField("query", T.LongType()), found.schema["doc"], T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(found.schema["doc"].dataType)
    return found.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Columns item_id, rank, doc_id and score: the k documents that score highest for each item."""
    items = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("said")).distinct()
    size = items.agg(F.sum(F.octet_length("said") + 64)).first()[0] or 0
    passes = max(1, math.ceil(size / PASS_BYTES))
    items = kept(items.withColumn("pass", F.pmod(F.xxhash64("item", "said"), F.lit(passes))).withColumn("query", F.monotonically_increasing_id()))
    ranked = None
    for number in range(passes):
        queries = [(r["query"], r["said"].encode()) for r in items.filter(F.col("pass") == number).select("query", "said").collect()]  # PASS_BYTES, about
        found = _pass(docs, queries, k, doc_id, text)
        ranked = found if ranked is None else ranked.unionByName(found)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    ranked = ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(items.select("query", "item"), "query").select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
