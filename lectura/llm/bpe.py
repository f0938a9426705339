"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a block of documents are laid out in one array of tokens with links to their neighbours.
An inverted index files, for each token pair that has a rank, the positions where it stands in any word. Ranks are
taken in order from a heap; one merge is applied at all its positions at once, and only the pairs that touch a merged
position are filed anew. Every distinct word is thus encoded once a block, whatever number of times it occurs.

Defined results: null and empty texts have no ids and decode to no bytes; texts of any length are encoded whole;
repeated rows are encoded alike; other columns, whatever their names, pass through `encode` untouched.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, slices, texts

#: A worker forgets its encoded chunks when it holds so many.
CACHE_ENTRIES = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


class MergeReplay:
    """Encodes words by the ranks; `pattern` splits texts into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.length = np.full(size + 1, -(1 << 20), np.int64)  # the last entry answers for dead positions
        whole = [b""] * size
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            whole[rank] = token
            self.length[rank] = len(token)
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank_of = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.bytes_of = pa.array(whole, pa.large_binary())
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, -1 for none."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's ids begin (one more entry: the end)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = flat.size
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = ends - np.fromiter(map(len, words), np.int64, len(words))
        token = np.append(self.of_byte[flat], -1)  # position n stands for "no neighbour"
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[ends - 1], before[starts], after[n], before[n] = n, n, n, n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            rank = self.pair_ranks(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not at.size:
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts) if cuts.size else [at], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        file(np.flatnonzero(after[:n] < n))
        while heap:
            r = heapq.heappop(heap)
            filed = index.pop(r)
            at = np.unique(filed[0] if len(filed) == 1 else np.concatenate(filed))
            right = after[at]
            live = self.length[token[at]] + self.length[token[right]] == self.length[r]
            at, right = at[live], right[live]
            if not at.size:
                continue
            if (clash := right[:-1] == at[1:]).any():  # of overlapping pairs every other one merges, from the left
                place = np.arange(at.size)
                first = np.maximum.accumulate(np.where(np.append(False, clash), 0, place))
                at, right = at[(place - first) % 2 == 0], right[(place - first) % 2 == 0]
            beyond = after[right]
            token[at], token[right], after[at], before[beyond] = r, -1, beyond, at
            left = before[at]
            file(np.concatenate([left[left < n], at[beyond < n]]))
        alive = token[:n] >= 0
        return token[:n][alive], np.append(0, np.cumsum(np.add.reduceat(alive, starts)))

    def learn(self, chunks: list[str]) -> None:
        """Adds the ids of chunks (as bytes of int32) to those known; a chunk is split into words on its own."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        place: dict[str, int] = {}
        split = [[place.setdefault(w, len(place)) for w in self.split(c)] for c in new]
        ids, begin = self.replay([w.encode() for w in place])
        raw, begin = ids.astype(np.int32).tobytes(), begin.tolist()
        for chunk, words in zip(new, split, strict=True):
            self.known[chunk] = b"".join([raw[4 * begin[w] : 4 * begin[w + 1]] for w in words])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin (one more entry: the end).

        A single space between two characters that aren't white space always begins a word, so texts fall there into
        chunks that can be split into words one by one.
        """
        parts = pc.split_pattern(column, " ")
        begin = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        pieces, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        odd = np.fromiter((not p or p[0].isspace() or p[-1].isspace() for p in pieces), bool, len(pieces))[code]
        code = code * 2 + 1
        code[begin[:-1][begin[:-1] < begin[1:]]] -= 1  # a text's first piece has no space before it
        chunks, place = [], np.full(2 * len(pieces), -1, np.int64)
        rare = np.add.reduceat(np.append(odd, False), begin[:-1]) * (begin[1:] > begin[:-1]) > 0 if len(begin) > 1 else np.zeros(0, bool)
        own: dict[int, list[int]] = {}
        extra: dict[str, int] = {}
        for i in np.flatnonzero(rare).tolist():
            cut = regex.split(r"(?<=\S) (?=\S)(?V1)", column[i].as_py())
            own[i] = [extra.setdefault(c if not k else " " + c, len(extra)) for k, c in enumerate(cut)]
        plain = np.repeat(~rare, np.diff(begin))
        used = np.zeros(2 * len(pieces), bool)
        used[code[plain]] = True
        seen = np.flatnonzero(used)
        place[seen] = np.arange(seen.size)
        chunks = [pieces[c >> 1] if not c & 1 else " " + pieces[c >> 1] for c in seen.tolist()] + list(extra)
        self.learn(chunks)
        found = [self.known[c] for c in chunks]
        flat = np.frombuffer(b"".join(found), np.int32)
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(count) - count
        if own:
            order = np.concatenate([np.asarray(own[i], np.int64) + seen.size if i in own else place[code[begin[i] : begin[i + 1]]] for i in range(len(column))])
            chunk_begin = np.append(0, np.cumsum([len(own[i]) if i in own else begin[i + 1] - begin[i] for i in range(len(column))]))
        else:
            order, chunk_begin = place[code], begin
        each = count[order]
        total = np.append(0, np.cumsum(each))
        ids = flat[np.repeat(start[order] - total[:-1], each) + np.arange(total[-1])]
        return ids, total[chunk_begin]

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """The bytes of each row of ids."""
        whole = self.bytes_of.take(pa.array(ids))
        at = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[begin])), whole.buffers()[2] if len(whole) else pa.py_buffer(b"")])


_replays: dict[int, MergeReplay] = {}


def _replay_of(broadcast, pattern: str) -> MergeReplay:
    key = hash((broadcast._jbroadcast.id() if broadcast._jbroadcast else id(broadcast), pattern))
    if key not in _replays:
        _replays.clear()
        _replays[key] = MergeReplay(broadcast.value, pattern)
    return _replays[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds array<int> `ids` to every row, without special tokens; and their bytes as `decoded` if that is named.

    The rank file is read where this is called and sent to the executors: its size doesn't depend on the corpus. Input
    columns with one of these names are replaced.
    """
    df = df.drop(ids, *([decoded] if decoded else []))
    spark: SparkSession = bounded_batches(df)
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    more = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])]
    schema = T.StructType([*df.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay_of(ranks, pattern)
        for part in slices(batches, text):
            found, begin = replay.encode(texts(part, text))
            column = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(found, pa.int32()))
            more = {decoded: replay.decode(found, begin).cast(pa.binary())} if decoded else {}
            yield pa.RecordBatch.from_arrays([*part.columns, column, *more.values()], names=[*part.schema.names, ids, *more])

    return df.mapInArrow(run, schema)
