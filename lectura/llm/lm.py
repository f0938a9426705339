"""Language-model scoring with a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are the words between ASCII white space with A-Z lower-cased, then one end of text. The model has `CLASSES`
classes: the most frequent training words, `RARE` classes of all other words by the hash of their last three letters,
and the end; the start stands only in contexts. So the model predicts every token: as a word, or as a class and the
word's share of it. The prediction is the sum of the two classes before, each scaled by its place's vector; its product
with a class's vector plus the class's bias is the score.

Training: documents are dealt by a hash of their classes into shards of about `SHARD` tokens, as many as the corpus
makes, so results don't depend on how the input is partitioned. Each shard passes once over the trigrams of its
documents (unique ones of a block with their counts), with minibatches whose noise sample is shared, by AdaGrad; weights
and AdaGrad's sums are averaged over the shards by their tokens and begin the next of `ROUNDS` rounds.

Scoring: batched matrix products of contexts with all class vectors give exact normalisers, so log-probabilities are
normalised. A word of a rare class takes the share (c + 0.1) / (N' + 0.1 (V' + 1)) of it, c being its training count and
N', V' the tokens and distinct words of the class.

Counts cover all training documents. The `HEAD` most frequent words (a fixed number) are sent to all executors; the
counts of all others meet their documents by a shuffled join.

Defined results: null texts are empty, and an empty text has one token, its end; texts of any length are scored whole;
repeated rows and rows with null ids get scores of their own; without training documents all counts are zero; an empty
table gives no rows; `score` passes the id columns on and ignores others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, kept, slices, texts, unused

CLASSES, RARE, HEAD, DIMENSION, CONTEXT = 1024, 384, 200_000, 32, 2
BATCH, NOISE, RATE, ROUNDS = 4096, 64, 0.1, 2
#: Tokens of a shard, and of a block of it whose equal trigrams count as one.
SHARD, BLOCK = 8_000_000, 500_000
#: Words that a counting task holds before it passes their counts on.
COUNTED_AT_ONCE = 400_000
SMOOTH = 0.1


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts one after another, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat = split.flatten()
    size = np.diff(split.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves an empty string there
        owner = np.repeat(np.arange(size.size), size)
        size = np.bincount(owner[full], minlength=size.size)
        flat = flat.filter(pa.array(full))
    return flat.dictionary_encode(), size


def rare_classes(words: pa.Array, rare: int = RARE) -> np.ndarray:
    """The rare class of each word, whether it is rare or not."""
    ends = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    of = np.fromiter((zlib.crc32(e.encode()) % rare for e in ends.dictionary.to_pylist()), np.int64, len(ends.dictionary))
    return of[ends.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


@dataclass
class Weights:
    """Vectors of context words and classes, scale of each context place, biases of classes."""

    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray) -> Weights:
        draw = np.random.Generator(np.random.PCG64(7)).normal
        k = share.size
        return cls(draw(0, 0.3, (k + 1, DIMENSION)).astype(np.float32), draw(0, 0.1, (k, DIMENSION)).astype(np.float32), np.ones((CONTEXT, DIMENSION), np.float32), np.log(share).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.place, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Weights(*out)

    def predicted(self, pairs: np.ndarray) -> np.ndarray:
        """The prediction of each row of `CONTEXT` words."""
        return sum(self.context[pairs[:, i]] * self.place[i] for i in range(CONTEXT))


def _scattered(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    def __init__(self, weights: Weights, seen: Weights, share: np.ndarray, seed: int):
        self.w = Weights(*(a.copy() for a in weights.arrays()))
        self.seen = [a.copy() for a in seen.arrays()]
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.steps = np.cumsum(share)
        self.random = np.random.Generator(np.random.PCG64(seed))
        self.tokens = 0

    def _move(self, which: int, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        self.seen[which][rows] += gradient * gradient
        self.w.arrays()[which][rows] += RATE * gradient / np.sqrt(self.seen[which][rows])

    def block(self, classes: np.ndarray, begin: np.ndarray, outside: int) -> None:
        """One pass over a block's documents (classes with their ends); `outside` is the start's place in contexts."""
        keys = trigrams(classes, begin, outside)
        keys, count = np.unique(keys, return_counts=True)
        self.tokens += int(count.sum())
        order = self.random.permutation(keys.size)
        k = outside + 1
        for at in range(0, keys.size, BATCH):
            some = keys[order[at : at + BATCH]]
            self._step(np.stack([some // k // k, some // k % k], 1), some % k, count[order[at : at + BATCH]].astype(np.float32))

    def _step(self, pairs: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        w = self.w
        weight = weight / weight.sum()
        noise = np.minimum(np.searchsorted(self.steps, self.random.random(NOISE) * self.steps[-1]), w.bias.size - 1)
        made = w.predicted(pairs)
        own, others = w.target[target], w.target[noise]
        true = (made * own).sum(1) + w.bias[target] - self.log_noise[target]
        false = made @ others.T + w.bias[noise] - self.log_noise[noise]
        up = weight / (1 + np.exp(np.clip(true, -30, 30)))  # ascent on the true class
        down = -weight[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        toward = up[:, None] * own + down @ others
        rows = np.concatenate([target, noise])
        changed, moved = _scattered(rows, np.concatenate([np.column_stack([up[:, None] * made, up]), np.column_stack([down.T @ made, down.sum(0)])]))
        scale = np.stack([(toward * w.context[pairs[:, i]]).sum(0) for i in range(CONTEXT)])
        heard, felt = _scattered(pairs.T.ravel(), np.concatenate([toward * w.place[i] for i in range(CONTEXT)]))
        self._move(1, changed, moved[:, :-1])
        self._move(3, changed, moved[:, -1])
        self._move(0, heard, felt)
        self._move(2, slice(None), scale)


def trigrams(classes: np.ndarray, begin: np.ndarray, outside: int) -> np.ndarray:
    """For each token the number (two before, one before, class) to the base of outside + 1; `outside` before a text."""
    one, two = np.empty_like(classes), np.empty_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    first = begin[:-1]
    one[first] = two[first] = outside
    second = first + 1
    two[second[second < begin[1:]]] = outside
    k = outside + 1
    return (two.astype(np.int64) * k + one) * k + classes


@dataclass(frozen=True)
class Corpus:
    """What the training documents tell: all tokens and distinct ones, ends, and the most frequent words' counts."""

    tokens: int
    distinct: int
    ends: int
    head: pa.Array
    head_counts: np.ndarray
    n_words: int  # of the head that are classes of their own
    rare_tokens: np.ndarray  # of each rare class: tokens and distinct words
    rare_words: np.ndarray

    @property
    def end(self) -> int:
        return self.n_words + self.rare_tokens.size

    @property
    def outside(self) -> int:
        return self.end + 1

    def share(self) -> np.ndarray:
        """The classes' shares of the training tokens, smoothed."""
        counts = np.concatenate([self.head_counts[: self.n_words], self.rare_tokens, [self.ends]]) + 1.0
        return counts / counts.sum()

    def rest(self) -> np.ndarray:
        """The log10 of what a word's smoothed count is divided by in its rare class."""
        return np.log10(self.rare_tokens + SMOOTH * (self.rare_words + 1))

    def classes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
        """Classes of all tokens with their ends, where texts begin; and of the words only: place in the head (-1: none), words, sizes."""
        coded, size = words_of(column)
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.head), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        begin = np.append(0, np.cumsum(size + 1))
        classes = np.full(int(begin[-1]), self.end, np.int64)
        at = np.arange(place.size) + np.repeat(np.arange(size.size), size)
        rare = self.n_words + rare_classes(coded.dictionary, self.rare_tokens.size)
        classes[at] = np.where((place >= 0) & (place < self.n_words), place, rare[coded.indices.to_numpy()]) if len(coded) else place
        return classes, begin, place, coded, size


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and n; the null word stands for the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for part in slices(batches, "text"):
            coded, size = words_of(texts(part))
            ends += size.size
            held.append(pa.table({"word": coded.dictionary.cast(pa.large_string()), "n": pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64))}))
            if sum(map(len, held)) > COUNTED_AT_ONCE:
                held = [merged()]
                if len(held[0]) > COUNTED_AT_ONCE // 2:
                    yield from held.pop().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(50_000)
        if held:
            yield from merged().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(50_000)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus_of(counts: DataFrame, classes: int = CLASSES, head: int = HEAD, rare: int = RARE) -> Corpus:
    """Reads the totals and the `head` most frequent words from the counts."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    most = counts.filter("word is not null").orderBy(F.desc("n"), "word").limit(head).toArrow()
    words, n = most.column("word").combine_chunks().cast(pa.large_string()), most.column("n").to_numpy().astype(np.int64)
    n_words = max(0, min(classes - rare - 2, len(most)))
    # the classes' sums over all words (as many rows as classes), less those of the words with classes of their own
    of = F.pmod(F.crc32(F.right("word", F.lit(3)).cast("binary")), F.lit(rare)).alias("k")
    tokens, distinct = np.zeros(rare, np.int64), np.zeros(rare, np.int64)
    for r in counts.filter("word is not null").groupBy(of).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["k"]], distinct[r["k"]] = r["n"], r["v"]
    own = rare_classes(words.slice(0, n_words), rare)
    tokens -= np.bincount(own, n[:n_words], rare).astype(np.int64)
    distinct -= np.bincount(own, minlength=rare)
    return Corpus(total["n"] or 0, total["v"], total["ends"] or 0, words, n, n_words, tokens, distinct)


def coded(docs: DataFrame, corpus: Corpus, text: str = "text", shard: int = SHARD) -> DataFrame:
    """shard, h (a hash of the classes, in whose order a shard is learned from) and the classes of each document with its end."""
    shards = max(1, -(-corpus.tokens // shard))
    sent = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            classes, begin = sent.value.classes(texts(part))[:2]
            rows = [classes[a:b].astype(np.uint16).tobytes() for a, b in zip(begin, begin[1:], strict=False)]
            h = np.array([xxhash.xxh64_intdigest(r) for r in rows], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(shards)).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(rows, pa.binary())], names=["shard", "h", "classes"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "shard long, h long, classes binary")
    return cut(rows.repartition(shards, "shard").sortWithinPartitions("shard", "h"))


def train(docs: DataFrame, corpus: Corpus, text: str = "text", rounds: int = ROUNDS, shard: int = SHARD) -> Weights:
    """The model's weights after `rounds` passes over all documents; shards' weights are averaged on executors."""
    spark, share = docs.sparkSession, corpus.share()
    weights = Weights.start(share)
    seen = Weights(*(np.full(a.shape, 1e-3, np.float32) for a in weights.arrays()))
    rows = coded(docs, corpus, text, shard)
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((corpus.outside, weights, seen, share))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            outside, begun, felt, share = sent.value
            last, trainer, held, size = None, None, [], 0

            def learn() -> None:
                nonlocal held, size
                if held:
                    trainer.block(np.concatenate(held).astype(np.int64), np.append(0, np.cumsum([h.size for h in held])), outside)
                held, size = [], 0

            def done() -> pa.RecordBatch:
                learn()
                both = np.concatenate([trainer.w.flat(), *(a.ravel() for a in trainer.seen)])
                return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([both.tobytes()], pa.binary())], names=["shard", "tokens", "w"])

            for batch in batches:
                for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("classes"), strict=True):
                    if shard != last:
                        if last is not None:
                            yield done()
                        last, trainer = shard, Trainer(begun, felt, share, 1000 + number)
                    held.append(np.frombuffer(blob.as_buffer(), np.uint16))
                    size += held[-1].size
                    if size >= BLOCK:
                        learn()
            if last is not None:
                yield done()

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = None, 0
            for batch in batches:
                for n, blob in zip(batch.column("tokens").to_pylist(), batch.column("w").to_pylist(), strict=True):
                    added = np.frombuffer(blob, np.float32).astype(np.float64) * n
                    total, tokens = added if total is None else total + added, tokens + n
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], names=["shard", "tokens", "w"])

        kind = "shard long, tokens long, w binary"
        parts = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
        # in the order of shards, so that sums are the same however they were learned
        some = rows.mapInArrow(run, kind).repartition(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard").mapInArrow(averaged, kind)
        done = some.repartition(1).sortWithinPartitions("tokens").mapInArrow(averaged, kind).collect()
        if done:
            both = np.frombuffer(done[0]["w"], np.float32)
            weights, seen = weights.like(both[: both.size // 2]), seen.like(both[both.size // 2 :])
    return weights


class Scorer:
    """Normalised log10 probabilities of tokens; normalisers are computed once for each context."""

    def __init__(self, weights: Weights, outside: int):
        self.w, self.outside = weights, outside
        self.normal = np.full((outside + 1) ** 2, np.nan, np.float32)

    def log10(self, classes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        w, k = self.w, self.outside + 1
        keys = trigrams(classes, begin, self.outside)
        unique, back = np.unique(keys, return_inverse=True)
        context, target = unique // k, unique % k
        new = np.unique(context)
        new = new[np.isnan(self.normal[new])]
        for at in range(0, new.size, BATCH):
            some = new[at : at + BATCH]
            score = w.predicted(np.stack([some // k, some % k], 1)) @ w.target.T + w.bias
            most = score.max(1)
            self.normal[some] = most + np.log(np.exp(score - most[:, None]).sum(1))
        out = np.empty(unique.size)
        for at in range(0, unique.size, 1 << 16):
            c, t = context[at : at + (1 << 16)], target[at : at + (1 << 16)]
            out[at : at + (1 << 16)] = (w.predicted(np.stack([c // k, c % k], 1)) * w.target[t]).sum(1) + w.bias[t] - self.normal[c]
        return (out / np.log(10))[back]


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, corpus: Corpus, counts: DataFrame, weights: Weights, ids: list[str], text: str = "text") -> DataFrame:
    """ids, n_tokens, n_known, base_score (smoothed unigrams of the training tokens), score (the model), per row."""
    sent = docs.sparkSession.sparkContext.broadcast((corpus, weights))
    number = id(sent)
    row = unused(docs, "row_number")
    rows = docs.select(*ids, F.monotonically_increasing_id().alias(row), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [f for f in rows.schema.fields if f.name != "text"]
    more = T._parse_datatype_string("n_tokens long, n_known long, all_logs double, other_logs double, rest double, model double, words array<string>, times array<int>")
    schema = T.StructType([*fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value
        if number not in _scorers:
            _scorers.clear()
            _scorers[number] = Scorer(w, known.outside)
        scorer = _scorers[number]
        logs = np.log10(np.append(known.head_counts, 0) + SMOOTH)
        end_log = np.log10(known.ends + SMOOTH)
        rest = known.rest()
        for part in slices(batches, "text"):
            classes, begin, place, coded, size = known.classes(texts(part))
            first = begin[:-1]
            n = size.size
            owner = np.repeat(np.arange(n), size)
            headed, other = place >= 0, place >= known.n_words
            word_class = classes[np.arange(place.size) + owner]
            sums = lambda mask, values, owner=owner, n=n: np.bincount(owner[mask], values[mask], n)
            mine = logs[place] if place.size else np.zeros(0)
            own = pa.array(np.flatnonzero(~headed))
            rare = coded.indices.take(own).to_numpy()
            pairs, times = np.unique(owner[~headed].astype(np.int64) << 32 | rare, return_counts=True)
            listed = np.append(0, np.cumsum(np.bincount(pairs >> 32, minlength=n))).astype(np.int32)
            words = coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())
            columns = [
                pa.array(size + 1, pa.int64()),
                pa.array(np.bincount(owner[headed], minlength=n) + (known.ends > 0), pa.int64()),
                pa.array(sums(headed, mine) + end_log, pa.float64()),
                pa.array(sums(other, mine).astype(np.float64)),
                pa.array(sums(other | ~headed, rest[np.clip(word_class - known.n_words, 0, rest.size - 1)]).astype(np.float64)),
                pa.array(np.add.reduceat(scorer.log10(classes, begin), first)),
                pa.ListArray.from_arrays(pa.array(listed), words),
                pa.ListArray.from_arrays(pa.array(listed), pa.array(times, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + columns, names=schema.names)

    done = kept(rows.mapInArrow(run, schema))
    rare = done.select(row, F.explode(F.arrays_zip("words", "times")).alias("x")).select(row, F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts.filter("word is not null"), "word", "left").groupBy(row)
    n = F.coalesce(F.col("n"), F.lit(0))
    met = met.agg(F.sum(F.col("times") * F.log10(n + SMOOTH)).alias("rare_logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    whole = float(np.log10(corpus.tokens + SMOOTH * (corpus.distinct + 1)))
    logs = F.coalesce(F.col("rare_logs"), F.lit(0.0))
    out = done.drop("words", "times").join(met, row, "left")
    return out.select(
        *ids, "n_tokens", (F.col("n_known") + F.coalesce(F.col("rare_known"), F.lit(0))).cast("long").alias("n_known"),
        (F.col("all_logs") + logs - F.col("n_tokens") * whole).alias("base_score"), (F.col("model") + F.col("other_logs") + logs - F.col("rest")).alias("score"),
    )


def learn_and_score(docs: DataFrame, learned_from: Column, ids: list[str], text: str = "text", classes: int = CLASSES, head: int = HEAD, rounds: int = ROUNDS, rare: int = RARE, shard: int = SHARD) -> DataFrame:
    """Learns from the rows where `learned_from` holds and scores all; adds train_tokens."""
    bounded_batches(docs)
    known = docs.filter(learned_from)
    counts = kept(count_words(known, text))
    corpus = corpus_of(counts, classes, head, rare)
    weights = train(known, corpus, text, rounds, shard)
    return score(docs, corpus, counts, weights, ids, text).withColumn("train_tokens", F.lit(corpus.tokens).cast("long"))
