"""Near duplicates by SimHash, with pigeonring filtering of candidates.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of `SHINGLE` words with repeats (all words if
there are fewer), XXH64 of each; a bit is 1 if it is set in over half of the hashes, and no words give zero.

Candidates: a fingerprint is a ring of eight segments of a byte. If two fingerprints differ in at most three bits, some
chain of consecutive segments keeps within the proportional budget at each of its lengths: 3/8 bit for one segment,
6/8 for two, 9/8 for three, and so on; that is, its first two segments are equal, and its first five hold at most one
difference. So two of the third to fifth segments are equal too, and fingerprints meet under 24 exact keys of 32 bits
(eight starts, three choices of two). Each meeting is checked for its chain's budget, then for all its bits.

Equal fingerprints are one node from the start. Under a key only a spanning forest of its links is made, not all pairs.
Keys that hold more than `CROWD` fingerprints are split by the pigeonhole rule over the bits that the key leaves free:
by four more bytes, then by four times six more bits; after that at most 2^18 different fingerprints can share a key.

Near copies (`near_copies`, `keep_one`) are texts whose sets of five-word shingles are 0.8 alike or more. The sets get
`RINGS` fingerprints, each of the shingles' hashes mixed in its own way, and each is a ring of its own. At 0.8 a bit
differs with a probability of 0.15, so budgets are six bits of 64: a chain of five segments whose first is equal holds
three differences at most, so one more of its segments is equal, which makes 28 keys of 16 bits. A pair within six bits
in any ring surely meets; a pair that is exactly 0.8 alike, with 9.7 bits on average, has ten rings of 28 keys to meet.
What meets in a ring and differs in at most `NEAR` of 128 bits (this ring and the next) is linked. What the first ring
links with the same least node goes through the other rings under its name, so that those add links between names, and
not again for each key that a group shares. The components of all links are judged by exact similarity: all are
compared with the one that met others most often; what is still apart then is compared, in blocks of bounded bytes, with
all of its component.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of any length are whole;
a repeated row is linked to its like; rows with a null id get a component by the others' ids, null if there are none
(`near_copies` links a set that no row with an id has to nothing); an empty table gives no rows; `near_duplicates` and `near_copies` use two columns only. `keep_one` returns the input's
columns: all rows that bear the least id of a group, or one row of a group without ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, slices, texts, unused
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Near copies: words of a shingle, tenths of similarity, rings, and bits of 128 that may differ before sets are compared.
COPY_SHINGLE, ALIKE, RINGS, NEAR = 5, 8, 10, 32
#: Nodes that are dealt out together; nodes in one part of a ring's segment, about; nodes under a key that are compared all with all.
DEALT_NODES, PART_NODES, RUN = 8192, 1 << 20, 48
#: Keys or nodes up to this many (16 or 24 bytes each) are sent to all executors; more are joined by shuffling.
BROADCAST_LONGS = 1_000_000
#: Bytes of shingle sets in a block of what stands in one group; shingles whose bits one step counts.
BLOCK_BYTES, STEP = 1 << 19, 255
#: Fingerprints under one key that are compared as they are.
CROWD = 2048


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begin, end[shingle - 1 :].tolist(), strict=False)], np.uint64)
    return int(majority(hashes[None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of each row of hashes the bits that over half of them set."""
    rows, n = hashes.shape
    set_bits = np.zeros((rows, 64), np.int64)
    for at in range(0, n, STEP):
        part = np.ascontiguousarray(hashes[:, at : at + STEP]).view(np.uint8).reshape(rows, -1, 8)
        set_bits += np.unpackbits(part, axis=2, bitorder="little").sum(1, dtype=np.uint8)
    return np.packbits(set_bits * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint_of(t, shingle) for t in texts(part).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(df)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _ring_keys(fp: Column) -> Column:
    """array<struct<key, rest, turn>>: the 24 keys and the 32 bits that each leaves free."""
    out = []
    for start in range(8):
        turned = fp if not start else F.shiftleft(fp, 8 * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * start))
        byte = lambda k, t=turned: F.shiftrightunsigned(t, 56 - 8 * k).bitwiseAND(F.lit(255).cast("long"))
        for out_of, (x, y) in ((4, (2, 3)), (3, (2, 4)), (2, (3, 4))):
            head = F.shiftrightunsigned(turned, 48)
            key = F.shiftleft(head, 16).bitwiseOR(F.shiftleft(byte(x), 8)).bitwiseOR(byte(y))
            number = F.lit((start * 3 + out_of - 2) << 32).cast("long")
            rest = F.shiftleft(turned.bitwiseAND(F.lit(0xFFFFFF).cast("long")), 8).bitwiseOR(byte(out_of))
            out.append(F.struct(number.bitwiseOR(key).alias("key"), rest.alias("rest"), F.lit(start).alias("turn")))
    return F.array(*out)


def _finer(rows: DataFrame, width: int) -> DataFrame:
    """Under a crowded key at most three of the 4 * width free bits differ, so one of four parts is equal."""
    mask = (1 << width) - 1
    parts = []
    for k in range(4):
        part = F.shiftrightunsigned("rest", width * k).bitwiseAND(F.lit(mask).cast("long"))
        low = F.col("rest").bitwiseAND(F.lit((1 << width * k) - 1).cast("long"))
        rest = F.shiftleft(F.shiftrightunsigned("rest", width * (k + 1)), width * k).bitwiseOR(low)
        parts.append(F.struct((part * 4 + k).alias("part"), rest.alias("rest")))
    split = rows.select("fp", "key", "sub", "turn", F.explode(F.array(*parts)).alias("p"))
    return split.select("fp", "key", (F.col("sub") * (4 << width) + F.col("p.part") + 1).alias("sub"), "turn", F.col("p.rest").alias("rest"))


def forest(values: np.ndarray, turn: int, bits: int = BITS) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints within `bits`, whose chain begins at segment `turn`."""
    left = values
    chain = np.uint64(((0xFFFFFFFFFF000000 >> 8 * turn) | (0xFFFFFFFFFF000000 << (64 - 8 * turn))) & (2**64 - 1))
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            here = todo.pop()
            differ = left ^ here
            near = np.flatnonzero(np.bitwise_count(differ & chain) <= 1)  # the chain's budget first
            near = near[np.bitwise_count(differ[near]) <= bits]
            if near.size:
                for other in left[near].tolist():
                    yield int(here), other
                todo.extend(left[near])
                left = np.delete(left, near)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links under each key of rows sorted by key; a key's rows may go over several batches."""
    held: list[np.ndarray] = []
    last = None

    def links(done: list[np.ndarray], key: tuple) -> list[tuple[int, int]]:
        return list(forest(np.unique(np.concatenate(done)), key[2])) if done else []

    found: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column("fp").to_numpy().view(np.uint64)
        key, sub, turn = (batch.column(c).to_numpy() for c in ("key", "sub", "turn"))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1).tolist(), len(fp)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            this = (key[a], sub[a], int(turn[a]))
            if last is not None and this != last:
                found.extend(links(held, last))
                held = []
            last = this
            held.append(fp[a:b].copy())
        if len(found) > 50_000:
            yield out()
    if last is not None:
        found.extend(links(held, last))
    yield out()


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links a, b that connect what differs in at most three bits, among distinct fingerprints (column fp)."""
    # 24 rows come from one, so they are made in as many tasks as a shuffle has, however small the fingerprints are
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.select("fp").repartition(tasks, F.xxhash64("fp"))
    rows = spread.select("fp", F.explode(_ring_keys(F.col("fp"))).alias("k")).select("fp", "k.key", F.lit(0).cast("long").alias("sub"), "k.turn", "k.rest")
    parts = []
    for width in (8, 6, None):
        rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "sub")))
        few = rows.filter("n > 1") if width is None else rows.filter((F.col("n") > 1) & (F.col("n") <= crowd))
        parts.append(few.select("fp", "key", "sub", "turn"))
        if width:
            rows = _finer(rows.filter(F.col("n") > crowd), width)
    met = parts[0].unionByName(parts[1]).unionByName(parts[2])
    met = met.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return met.mapInArrow(_solve, "a long, b long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links lead to, its own included) of every row."""
    marked = cut(fingerprints(df, doc_id, text, shingle))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), crowd))
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = joined.join(least, "root").select("fp", "component_id")
    return marked.join(of_node, "fp").select("doc_id", "fp", "component_id")


_mix = np.random.default_rng(SEED).integers(1, 1 << 63, (RINGS - 1, 1), np.uint64) | np.uint64(1)


def shingles_of(text: bytes, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The sorted set of hashes of a UTF-8 text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size).tolist(), end[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=False)], np.uint64))


def rings_of(found: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of hashes: of the hashes themselves, then of RINGS - 1 mixtures."""
    mixed = found[None] * _mix
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return majority(np.concatenate([found[None], mixed]))


def _alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others reach the similarity with one."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    out = 10 * np.minimum(size, one.size) >= ALIKE * np.maximum(size, one.size)
    some = np.flatnonzero(out & (size > 0))
    if some.size and one.size:
        flat = np.concatenate([others[k] for k in some.tolist()])
        place = np.minimum(np.searchsorted(one, flat), one.size - 1)
        both = np.add.reduceat((one[place] == flat).astype(np.int64), np.append(0, np.cumsum(size[some])[:-1]))
        out[some] = 10 * both >= ALIKE * (one.size + size[some] - both)
    return out


def _set_hash(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _sketched(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, node (of the shingle set) and its fingerprints of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles_of(t) for t in texts(part).cast(pa.large_binary()).to_pylist()]
            node = np.array([_set_hash(s) for s in sets], np.uint64).view(np.int64)
            rings = np.array([rings_of(s) for s in sets], np.uint64).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, rings.size + 1, RINGS, dtype=np.int32)), pa.array(rings.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node), listed], names=["doc_id", "node", "rings"])

    bounded_batches(df)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, rings array<long>")


def _segment(rings: np.ndarray, k: int) -> np.ndarray:
    return rings >> np.uint64(56 - 8 * (k % 8)) & np.uint64(255)


def _within(rows: np.ndarray, bits: int) -> np.ndarray:
    """Links x, y that connect what differs in at most `bits` bits, among rows of node, ring and next ring.

    Many rows get fewer links than twice their number, not all pairs.
    """
    words = rows[:, 1:]
    if len(rows) <= 2 * RUN:
        apart = np.bitwise_count(words[:, None] ^ words[None]).sum(2, dtype=np.int64)
        return np.argwhere(np.triu(apart <= bits, 1))
    # what is within half of the bits of the middle is within all of them of each other, however much it is
    middle = majority(np.ascontiguousarray(words.T))
    core = np.flatnonzero(2 * np.bitwise_count(words ^ middle).sum(1, dtype=np.int64) <= bits)
    found = [np.stack([np.full(core.size - 1, core[0]), core[1:]], 1)] if core.size > 1 else []
    one, two = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    near = lambda x, some: np.bitwise_count(one[some] ^ one[x]) + np.bitwise_count(two[some] ^ two[x]) <= bits
    left = np.setdiff1d(np.arange(len(rows)), core)
    while left.size:
        todo, left, met = [int(left[0])], left[1:], core[:0]
        while todo:
            here = todo.pop()
            if not met.size:  # one link with the core is enough for all that are reached
                met = core[near(here, core)][:1]
                found.append(np.stack([np.full(met.size, here), met], 1))
            new = near(here, left)
            if new.any():
                found.append(np.stack([np.full(new.sum(), here), left[new]], 1))
                todo.extend(left[new].tolist())
                left = left[~new]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def ring_groups(rows: np.ndarray, start: int, bits: int = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups and nodes of what meets in chains from segment `start`, for each key; rows hold node, ring and next ring.

    A group is what links of at most `bits` bits connect under a key; it is named by its nodes, so that equal ones are one.
    """
    for step in range(1, 5):
        if step == 4 and start >= 4:
            continue  # the chain from the opposite segment has this key
        key = (_segment(rows[:, 1], start) << np.uint64(8) | _segment(rows[:, 1], start + step)).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        held, key = rows[order], key[order]
        begin = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        size = np.diff(np.append(begin, len(key)))
        links = [_within(held[a : a + n], bits) + a for a, n in zip(begin[size > RUN].tolist(), size[size > RUN].tolist(), strict=True)]
        end = np.repeat(np.where(size > RUN, begin, begin + size), size)  # runs that are done have no others
        node, one, two = (np.ascontiguousarray(held[:, c]) for c in range(3))
        here, far = np.arange(len(key)), 1
        while (here := here[here + far < end[here]]).size:
            other = here + far
            near = np.bitwise_count(one[here] ^ one[other]) + np.bitwise_count(two[here] ^ two[other]) <= bits
            links.append(np.stack([here[near], other[near]], 1))
            far += 1
        x, y = np.concatenate(links).T if links else np.zeros((2, 0), np.int64)
        root = np.arange(len(key))
        while x.size:
            least = np.minimum(root[x], root[y])
            if (least == root[x]).all() and (least == root[y]).all():
                break
            for end_of in (root[x], root[y], x, y):
                np.minimum.at(root, end_of, least)
            root = root[root]
        linked = np.unique(np.concatenate([x, y]))
        linked = linked[np.argsort(root[linked], kind="stable")]
        if linked.size:
            first = np.append(0, np.flatnonzero(np.diff(root[linked])) + 1)
            mixed = (node[linked] ^ node[linked] >> np.uint64(31)) * _mix[0]
            mixed = (mixed ^ mixed >> np.uint64(29)) * _mix[1]
            names = np.add.reduceat(mixed ^ mixed >> np.uint64(32), first)
            yield np.repeat(names, np.diff(np.append(first, linked.size))), node[linked]


def _dealt(chosen: range, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes with ring and next ring by ring of those chosen, first segment of a chain, and one of `parts` parts of its values."""

    def packed(node: np.ndarray, rings: np.ndarray) -> Iterator[pa.RecordBatch]:
        for r in chosen:
            rows = np.stack([node, rings[:, r], rings[:, (r + 1) % RINGS]], 1)
            places, blobs = [], []
            for start in range(8):
                part = (_segment(rows[:, 1], start).astype(np.int64) * 157 % 256) * parts // 256
                order = np.argsort(part, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    places.append((r * 8 + start) * 256 + int(part[some[0]]))
                    blobs.append(rows[some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(blobs, pa.binary())], names=["place", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rings = batch.column("rings").flatten().to_numpy().view(np.uint64).reshape(-1, RINGS)
            held.append((batch.column("node").to_numpy().view(np.uint64), rings))
            n += batch.num_rows
            if n >= DEALT_NODES:
                yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group's nodes with its least, and how often each was made; rows are sorted by place."""
    held: list[bytes] = []
    made: list[np.ndarray] = []
    last = None

    def solve() -> None:
        rows = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 3)
        held.clear()
        for key, node in ring_groups(rows, last // 256 % 8):
            begin, node = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1), node.view(np.int64)
            least = np.repeat(np.minimum.reduceat(node, begin), np.diff(np.append(begin, key.size)))
            made.append(np.stack([node, least], 1)[node != least])

    def out() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(made), axis=0, return_counts=True)
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], names=["a", "b", "n"])

    for batch in batches:
        for place, rows in zip(batch.column("place").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            if held and place != last:
                solve()
                if sum(map(len, made)) > 500_000:
                    yield out()
            last = place
            held.append(rows)
    if held:
        solve()
    if made:
        yield out()


def _meeting(nodes: DataFrame, chosen: range, parts: int) -> DataFrame:
    """Links a, b among the names of what meets in the chosen rings, and n, how often each was made, from distinct node with name and rings."""
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.repartition(tasks, F.xxhash64("node")).select(F.col("name").alias("node"), "rings")
    dealt = spread.mapInArrow(_dealt(chosen, parts), "place int, rows binary").repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(_chained, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def ring_links(nodes: DataFrame) -> DataFrame:
    """Links a, b that connect all that meets in rings, n, how often each was made, and if `first`, by the first ring, from distinct node and rings.

    In the other rings the least node that the first ring links a node with stands for it.
    """
    n = nodes.count()
    parts = 1 << min(8, max(3, (n // PART_NODES).bit_length()))
    first = cut(_meeting(nodes.select("node", "rings", F.col("node").alias("name")), range(1), parts))
    roots = first.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))  # b is the lesser end
    small = F.broadcast if n <= BROADCAST_LONGS else (lambda x: x)
    named = nodes.join(small(roots), "node", "left").select("node", "rings", F.coalesce("root", "node").alias("name"))
    others = _meeting(named, range(1, RINGS), parts)
    return first.withColumn("first", F.lit(True)).unionByName(others.withColumn("first", F.lit(False)))


def _sets(rows: DataFrame) -> DataFrame:
    """node and its shingle set, once each, from rows of node and text; a text that isn't the node's gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles_of(t) for t in texts(part).cast(pa.large_binary()).to_pylist()]
            right = [np.uint64(_set_hash(s)).astype(np.int64) == n for s, n in zip(sets, part.column("node").to_pylist(), strict=True)]
            held = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("node"), held], names=["node", "shingles"]).filter(pa.array(right, pa.bool_()))

    return rows.select("node", "text").mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, holder: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b = (part.column(c).to_pylist() for c in ("set_a", "set_b"))
            keep = [bool(_alike(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)])[0]) for x, y in zip(a, b, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: holder.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between what is apart and all others of a block; rows are sorted by key and block."""
    columns = ("node", "root", "apart", "inner", "shingles")
    held: dict[str, list] = {}
    last = None

    def solved() -> Iterator[pa.RecordBatch]:
        node, root = (np.array(held[c], np.int64) for c in ("node", "root"))
        inner, apart = np.array(held["inner"], bool), np.array(held["apart"], bool)
        sets = [np.frombuffer(s, np.uint64) for s in held["shingles"]]
        theirs = np.flatnonzero(inner)
        links: list[tuple[int, int]] = []
        for x in np.flatnonzero(~inner).tolist():
            some = theirs[(root[theirs] != root[x]) & (~apart[theirs] | (node[theirs] > node[x]))]
            if some.size:
                links += [(int(node[x]), n) for n in node[some[_alike(sets[x], [sets[k] for k in some.tolist()])]].tolist()]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        found = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "one", "other")]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in found], 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            this = tuple(int(c[a]) for c in found)
            if last is not None and this != last:
                yield from solved()
                held = {}
            last = this
            for c in columns:
                held.setdefault(c, []).extend(batch.column(c).slice(a, b - a).to_pylist())
    if last is not None:
        yield from solved()


def _still_apart(under: DataFrame, roots: DataFrame, holder: DataFrame, block: int) -> DataFrame:
    """Links that what is apart in a group (key) has with all that stands there.

    In each group the nodes of the root that most nodes have are in; the others are apart. Both are dealt into blocks
    of bounded bytes, and each block of what is apart (`inner` false) meets each block of all (`inner` true).
    """
    nodes = holder.select("node", "shingles")
    at = under.filter("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    at = at.join(split, "key").join(holder.select("node", (F.octet_length("shingles") + 256).alias("bytes")), "node")
    most = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).groupBy("key")
    most = most.agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("bytes").alias("all"), F.max(F.struct("n", "root", "bytes")).alias("m"))
    most = most.select("key", "most", F.ceil(F.col("all") / block).alias("ns"), F.ceil((F.col("all") - F.col("m.bytes")) / block).alias("n_apart"))
    at = at.join(most, "key").withColumn("apart", F.col("root") != F.col("most"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    inner = at.select("key", "node", "root", "apart", F.lit(True).alias("inner"), every("n_apart").alias("one"), own("ns").alias("other"))
    outer = at.filter("apart").select("key", "node", "root", "apart", F.lit(False).alias("inner"), own("n_apart").alias("one"), every("ns").alias("other"))
    dealt = inner.unionByName(outer).join(nodes, "node").repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    return dealt.mapInArrow(_met, "a long, b long")


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and component_id (the least doc_id that links of near copies lead to, its own included) of every row."""
    rows = cut(_sketched(df, doc_id, text))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("rings").alias("rings")))
    met = cut(ring_links(nodes))
    under = components(met).select("node", F.col("root").alias("key"))
    under = cut(under.join(under.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"))
    often = met.select(F.col("a").alias("node"), "n", "first").unionByName(met.select(F.col("b").alias("node"), F.lit(0).cast("long").alias("n"), "first"))
    # the first ring's links come first, as in others a node also has the links of all that it stands for
    counted = [F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0).cast("long")) for of in (F.col("first"), ~F.col("first"))]
    degrees = often.groupBy("node").agg(F.struct(counted[0].alias("first"), counted[1].alias("others")).alias("degree"))
    needed = cut(nodes.select("node", "least").join(degrees, "node"))
    small = F.broadcast if needed.count() <= BROADCAST_LONGS else (lambda x: x)
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts_of = source.join(small(needed.select("node", F.col("least").alias("doc_id"))), "doc_id")
    holder = cut(needed.join(_sets(texts_of), "node"))
    # the node that met others most often stands in the middle of its like
    placed = under.join(small(holder.select("node", "degree")), "node")
    hubs = placed.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    pairs = placed.join(hubs, "key").filter("node <> hub.node").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    links = cut(_confirmed(pairs, holder))
    roots = components(links)
    more = cut(_still_apart(under, roots, holder, block))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    joined = nodes.select("node", "least").join(small(roots), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(joined.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies: the rows of its least doc_id; columns as they are."""
    bare = df.filter(F.col(doc_id).isNull())
    if bare.isEmpty():
        found = near_copies(df, doc_id, text).filter("doc_id = component_id")
        name = unused(df, "kept_id")
        return df.join(found.select(F.col("doc_id").alias(name)).distinct(), F.col(doc_id) == F.col(name), "left_semi")
    # rows without an id stand behind all others, in an order of their own that is written down once
    number, key = unused(df, "row_number"), unused(df, "row_key")
    bare = cut(bare.withColumn(number, F.monotonically_increasing_id()))
    keyed = df.filter(F.col(doc_id).isNotNull()).withColumn(number, F.lit(-1).cast("long")).unionByName(bare)
    keyed = keyed.withColumn(key, F.struct(F.col(doc_id).isNull().alias("bare"), F.col(doc_id).alias("id"), F.col(number).alias("n")))
    kept = near_copies(keyed, key, text).filter("doc_id = component_id").select(F.to_json("doc_id").alias(number)).distinct()
    return keyed.drop(number).join(kept, F.to_json(key) == F.col(number), "left_semi").drop(key)
