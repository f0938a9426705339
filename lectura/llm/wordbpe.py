"""BPE over words with an end mark: each distinct word of the corpus is encoded once, ids come back by position.

Tasks cut the corpus into blocks of bounded text. A block keeps, for every text, the positions of its words: words that
are frequent in a bounded sample have one number everywhere and are encoded beforehand, all others a place in the
block's own list of distinct words. These lists meet by word: dealt by word and sorted, each run of a word is one entry
of the table of distinct words, is encoded once, and its ids go back to every block by place. A word stands in a block's
list once at most, so no word is hot. Decoding looks every id up in the table of pieces, whose size is that of the
vocabulary, and which each task holds. The sample has no influence on results.

Defined results: null and empty texts have no ids and decode to ""; texts of any length are encoded whole; repeated rows
are encoded alike; input columns with the name of an output are replaced, others pass through whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import json
import secrets
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, shared_dir, slices, texts

#: Bytes of text in a block (one longer text is a block of its own).
BLOCK_BYTES = 16 << 20
#: Below this code point the word rules of the vocabulary's library don't depend on its Unicode version.
STABLE = "Ԟ"
#: At most so many words of at most so many letters, the most frequent of about so many documents, are encoded beforehand.
FREQUENT, FREQUENT_LETTERS, SAMPLE_DOCS = 1 << 17, 40, 4000
#: Rows of ids that a task holds before it sends them back, those of a block together.
HELD_ROWS = 100_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordVocabulary:
    """Splits texts into words, and words into ids, by the content of a tokenizers JSON file."""

    def __init__(self, content: str):
        file = json.loads(content)
        model = file["model"]
        self.end, self.vocab = model["end_of_word_suffix"], model["vocab"]
        if model["type"] != "BPE" or not self.end or file["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("a BPE vocabulary with word ends is needed")
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = _byte_letters()
        self.letters = letters
        self.of_byte = [self.vocab[x] for x in letters]
        self.of_last = [self.vocab[x + self.end] for x in letters]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find, self.find_lines = regex.compile(pattern).findall, regex.compile(f"\\n|{pattern}").findall
        self.odd = f"[^\\x00-\\x{{{ord(STABLE) - 1:x}}}]" + "".join("|" + "".join(f"\\x{{{ord(c):x}}}" for c in x) for x in self.special)
        library = tokenizers.Tokenizer.from_str(content)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.piece_of = pa.array([piece for _, piece in sorted(self.pieces())], pa.string())
        if len(self.piece_of) != max(i for i, _ in self.pieces()) + 1:
            raise ValueError("ids must be dense")
        self.bytes = {x: b for b, x in enumerate(letters)}

    def pieces(self) -> list[tuple[int, str]]:
        """Every id and its piece."""
        return [(i, piece) for piece, i in {**self.vocab, **self.special}.items()]

    def words(self, chunk: str) -> list[str]:
        """The words of a text without white space; special tokens are words of their own."""
        if self.cut and not chunk.isalpha() and len(parts := self.cut(chunk)) > 1:
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words(part))]
        if chunk.isascii():
            return self.find(chunk.lower())
        if max(chunk) < STABLE:
            return self.find(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.split(self.normal(chunk))] if chunk else []

    def split_all(self, chunks: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of chunks, the places of all chunks' words among them, and each chunk's number of words.

        Chunks of stable letters that can't hold a special token are split together, as lines of one text.
        """
        odd = pc.match_substring_regex(chunks, self.odd).to_numpy(zero_copy_only=False)
        text = "\n".join(chunks.filter(pa.array(~odd)).to_pylist())
        found = self.find_lines(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        rest = [self.words(c) for c in chunks.filter(pa.array(odd)).to_pylist()]
        coded = pa.array([*found, *(w for words in rest for w in words)], pa.large_string()).dictionary_encode()
        line = pc.index(coded.dictionary, "\n").as_py()
        place = coded.indices.to_numpy()
        breaks = np.flatnonzero(place[: len(found)] == line)
        count = np.empty(len(chunks), np.int64)
        if len(odd) > len(rest):
            count[~odd] = np.diff(np.concatenate([[-1], breaks, [len(found)]])) - 1
        count[odd] = [len(words) for words in rest]
        flat = place[place != line]
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])  # chunks as their words stand in flat
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        total = np.cumsum(count) - count
        flat = flat[np.repeat(start - total, count) + np.arange(flat.size)]
        names = coded.dictionary.to_pylist()
        if line >= 0:
            names.pop(line)
            flat = flat - (flat > line)
        return names, flat.astype(np.int32), count

    def encode(self, word: str) -> list[int]:
        """The ids of a word: the pair of the least rank merges first, of equal ones the leftmost."""
        if word in self.special:
            return [self.special[word]]
        raw, merges = word.encode(), self.merges
        token = [self.of_byte[b] for b in raw]
        token[-1] = self.of_last[raw[-1]]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[pair], i) for i in range(n - 1) if (pair := (token[i], token[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            rank, whole, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or merges.get((token[i], token[j]), (-1,))[0] != rank:
                continue
            token[i], token[j], after[i] = whole, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (found := merges.get((whole, token[after[j]]))) is not None:
                    heapq.heappush(heap, (*found, i))
            if before[i] >= 0 and (found := merges.get((token[before[i]], whole))) is not None:
                heapq.heappush(heap, (*found, before[i]))
        return [t for t in token if t >= 0]


_vocabularies: dict[str, WordVocabulary] = {}


def _vocabulary(content) -> WordVocabulary:
    """The worker's vocabulary of a broadcast file."""
    key = str(content._jbroadcast.id() if content._jbroadcast else id(content))
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = WordVocabulary(content.value)
    return _vocabularies[key]


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _block(rows: list[pa.RecordBatch], text: str, keep: list[str], vocabulary: WordVocabulary, frequent: dict[str, int]) -> pa.RecordBatch:
    """A block: its rows with the numbers of their words, packed; and its distinct words beyond the frequent ones."""
    table = pa.Table.from_batches(rows)
    column = pa.chunked_array([texts(b, text) for b in rows]).combine_chunks()
    parts = pc.ascii_split_whitespace(column)
    coded = parts.flatten().dictionary_encode()
    names, flat, count = vocabulary.split_all(coded.dictionary)
    number = np.fromiter((frequent.get(w, -1) for w in names), np.int32, len(names))
    rare = np.flatnonzero(number < 0)
    number[rare] = len(frequent) + np.arange(rare.size)
    words, flat = [names[i] for i in rare.tolist()], number[flat] if len(names) else flat
    start = np.cumsum(count) - count
    code = coded.indices.to_numpy()
    total = np.append(0, np.cumsum(count[code]))
    codes = flat[np.repeat(start[code] - total[:-1], count[code]) + np.arange(total[-1])]
    begin = total[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    packed = _pack(table.select(keep).append_column("", pa.array(np.diff(begin))))
    return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(63)]), pa.array([packed]), pa.array([_squeezed(codes)], pa.binary()), pa.array([words], pa.list_(pa.string()))], ["block", "packed", "codes", "words"])


def _squeezed(codes: np.ndarray) -> bytes:
    """Whole numbers, their lowest bytes first and together: these hardly shrink, the others do."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueezed(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _blocks(df: DataFrame, text: str, keep: list[str], content, frequent) -> DataFrame:
    """Columns block, packed (rows and how many words each has), codes (all words' numbers) and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, held, size = _vocabulary(content), {w: i for i, w in enumerate(frequent.value[0])}, [], 0
        for batch in batches:
            bytes_of = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            for i, more in enumerate(bytes_of.tolist()):
                if size and size + more > BLOCK_BYTES:
                    held.append(batch.slice(at, i - at))
                    yield _block(held, text, keep, vocabulary, known)
                    held, size, at = [], 0, i
                size += more
            held.append(batch.slice(at))
        if held:
            yield _block(held, text, keep, vocabulary, known)

    return df.mapInArrow(run, "block long, packed binary, codes binary, words array<string>")


def _frequent(df: DataFrame, text: str, content) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The frequent words of a sample of bounded size, their ids one after another, and where each word's ids begin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for part in (p for batch in batches for p in slices(iter([batch]), text)):
            coded = pc.ascii_split_whitespace(texts(part, text)).flatten().dictionary_encode()
            names, flat, each = vocabulary.split_all(coded.dictionary)
            times = np.repeat(np.bincount(coded.indices.to_numpy(), minlength=len(each)), each)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.bincount(flat, times, len(names)).astype(np.int64))], ["word", "n"])

    some = df.select(text).sample(min(1.0, SAMPLE_DOCS / max(1, df.count())), seed=0)
    counts = some.mapInArrow(count, "word string, n long").filter(F.length("word") <= FREQUENT_LETTERS)
    most = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")
    found = _encoded(most, content).toArrow()
    ids = found.column("ids").combine_chunks()
    return found.column("word").to_pylist(), ids.flatten().to_numpy(), ids.offsets.to_numpy()


def _runs(word: pa.Array, vocabulary: WordVocabulary, last: list) -> pa.Array:
    """The ids of words; equal ones that follow each other, also from batch to batch, are encoded once."""
    runs = pc.run_end_encode(word)
    names = runs.values.to_pylist()
    found = [last[1] if last and w == last[0] else vocabulary.encode(w) for w in names]
    if names:
        last[:] = names[-1], found[-1]
    each = np.repeat(np.arange(len(names)), np.diff(runs.run_ends.to_numpy(), prepend=0))
    return pa.array(found, pa.list_(pa.int32())).take(pa.array(each))


def _encoded(words: DataFrame, content) -> DataFrame:
    """Columns word and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), _runs(batch.column("word"), _vocabulary(content), last)], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _sent_back(words: DataFrame, content) -> DataFrame:
    """Columns at (a block) and ids (places, numbers of ids and ids of some of its words, one array after another)."""

    def grouped(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
        at, code = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(at, kind="stable")
        ids = pa.chunked_array([h[2] for h in held]).combine_chunks().take(pa.array(order))
        begin, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
        at, code, count = at[order], code[order].astype("<i4"), np.diff(begin).astype("<i4")
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        rows = [(hi - lo).to_bytes(4, "little") + code[lo:hi].tobytes() + count[lo:hi].tobytes() + flat[begin[lo] : begin[hi]].astype("<i4").tobytes() for lo, hi in itertools.pairwise(cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]]), pa.array(rows, pa.binary())], ["at", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, last, held, size = _vocabulary(content), [], [], 0
        for batch in batches:
            held.append((batch.column("at").to_numpy(), batch.column("code").to_numpy(), _runs(batch.column("word"), vocabulary, last)))
            size += batch.num_rows
            if size >= HELD_ROWS:
                yield from grouped(held)
                held, size = [], 0
        if size:
            yield from grouped(held)

    return words.mapInArrow(run, "at long, ids binary")


def _arrived(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's words in the order of their places, and how many each word has."""
    codes, counts, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for raw in rows.to_pylist():
        n = int.from_bytes(raw[:4], "little")
        own = np.frombuffer(raw, "<i4", offset=4)
        codes.append(own[:n])
        counts.append(own[n : 2 * n])
        ids.append(own[2 * n :])
    code, count, flat = map(np.concatenate, (codes, counts, ids))
    order = np.argsort(code)
    start, each = (np.cumsum(count) - count)[order], count[order]
    return flat[np.repeat(start - (np.cumsum(each) - each), each) + np.arange(flat.size)], each


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Columns id and piece of a vocabulary."""
    with open(path, encoding="utf-8") as file:
        return spark.createDataFrame(WordVocabulary(file.read()).pieces(), "id int, piece string")


def _unpack(left: pa.Table, right: pa.Table, fields: pa.Schema, frequent: tuple[list[str], np.ndarray, np.ndarray], vocabulary: WordVocabulary | None) -> pa.Table:
    """The rows of a block with the ids of their words, and what these decode to if a vocabulary is given."""
    more, each = _arrived(right.column("ids"))
    _, flat, at = frequent
    at, flat = np.append(at, at[-1] + np.cumsum(each)), np.append(flat, more)
    out = []
    for blob, codes in zip(left.column("packed"), left.column("codes").to_pylist(), strict=True):
        with pa.ipc.open_stream(blob.as_buffer()) as stream:
            rows = stream.read_all().combine_chunks()
        begin, word = np.append(0, np.cumsum(rows.column(rows.num_columns - 1).to_numpy())), _unsqueezed(codes)
        each = np.diff(at)[word]
        total = np.append(0, np.cumsum(each))
        whole = flat[np.repeat(at[:-1][word] - total[:-1], each) + np.arange(total[-1])].astype(np.int32)
        more = [pa.LargeListArray.from_arrays(pa.array(total[begin]), pa.array(whole))]
        if vocabulary:
            said = vocabulary.piece_of.take(pa.array(whole))
            more.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(total[begin], pa.int32()), said), " "))
        columns = [rows.column(i) for i in range(rows.num_columns - 1)] + more
        out.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))
    return pa.concat_tables(out) if out else fields.empty_table()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """Adds array<int> `ids` to every row, and the text that they decode to as `decoded` if that is named.

    Special tokens in a text get their ids, as the file's library does by default; none are added. The vocabulary is
    read where this is called and sent to the executors. Without `keep_text` the text's column is left out.
    """
    spark = bounded_batches(df)
    with open(path, encoding="utf-8") as file:
        content = file.read()
    sent = spark.sparkContext.broadcast(content)
    taken = {ids.lower(), (decoded or ids).lower()} | (set() if keep_text else {text.lower()})
    keep = [c for c in df.columns if c.lower() not in taken]
    kinds = [f for f in df.schema if f.name in keep]
    more = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]
    schema = T.StructType([*kinds, *more])
    frequent = spark.sparkContext.broadcast(_frequent(df, text, sent))
    blocks = _written(_blocks(df, text, keep, sent, frequent))
    words = blocks.select(F.col("block").alias("at"), F.posexplode("words").alias("code", "word"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = _sent_back(words.repartition(n, "word").sortWithinPartitions("word"), sent)
    out = to_arrow_schema(schema)

    def unpack(left: pa.Table, right: pa.Table) -> pa.Table:
        return _unpack(left, right, out, frequent.value, _vocabulary(sent) if decoded else None)

    return blocks.select("block", "packed", "codes").groupBy("block").cogroup(back.groupBy("at")).applyInArrow(unpack, schema)


def _written(blocks: DataFrame) -> DataFrame:
    """The blocks as a table in the shared folder, bucketed by block so that ids meet them without moving them again."""
    spark, name = blocks.sparkSession, f"word_blocks_{secrets.token_hex(8)}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(n, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of every row's ids: each id joined with its piece, put together again in order, with spaces between.

    Rows with equal ids share one way through the join. Null ids decode to null, none to ""; unknown ids are left out.
    """
    key = F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
    each = df.select(key.alias("__key"), ids).filter(F.col("__key").isNotNull()).dropDuplicates(["__key"]).select("__key", F.posexplode(ids).alias("pos", "id"))
    found = each.join(F.broadcast(pieces(df.sparkSession, path)), "id").groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("all"))
    found = found.select("__key", F.array_join("all.piece", " ").alias("__said"))
    joined = df.drop(decoded).withColumn("__key", key).join(found, "__key", "left")
    return joined.withColumn(decoded, F.when(F.col(ids).isNotNull(), F.coalesce("__said", F.lit("")))).drop("__key", "__said")
