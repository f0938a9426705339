"""Removal of long byte strings that occurred earlier, by suffix arrays over anchored contexts.

Rule: a byte goes if it lies in a string of `LENGTH` bytes that also starts earlier (in a document with a smaller id,
or earlier in the same one). Strings are judged on the input; matches never cross documents.

1. Winnowing picks anchors: of the `SPAN` positions at which a gram of `GRAM` bytes can stand in a string of `LENGTH`
   bytes, the one with the least hash. Equal strings hold equal anchors at equal places, so every repeat shows as two
   anchors with one gram hash, and nothing else has to be compared.
2. Anchors meet by gram hash. Those whose whole context (every string of `LENGTH` bytes around the anchor) has the
   same hash form a class; all its members but the earliest are covered. Where a gram has several classes, the
   earliest member of each asks for its bytes.
3. Over the contexts of a gram an enhanced suffix array is built (suffixes of `LENGTH` bytes and more). A stack scan of
   its common prefixes gives the tree of prefix intervals; an interval whose members have different left neighbours is
   a maximal repeat, and all its occurrences but the earliest are covered.

Every step but the last sends packed arrays, pre-aggregated per block of documents, to buckets of hashes. A gram with
more than `GROUP` classes (an edge of a passage that very many documents hold) never meets in one task: its contexts
are cut into their strings, which meet by a 128-bit hash of the string, again pre-aggregated per block.

Defined results: null and empty texts have no bytes; texts under `LENGTH` bytes keep all; texts of any length are
judged whole; rows that repeat one doc_id must repeat its text and get equal results; a null doc_id takes no part and
keeps its text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, bounded_batches, slices, texts

LENGTH, GRAM = 100, 32
#: Classes of one gram that one suffix array takes; and classes in one block from which a gram counts as common.
GROUP, GROUP_IN_BLOCK = 512, 64
#: Contexts that are sorted in one array.
SORTED_AT_ONCE = 512
#: Bytes of packed arrays that a task gathers before it deals them out.
POOLED = 4 << 20

ANCHORS, COMMON, COVERS, ASKS, STRINGS, CONTEXTS, DOCUMENT = 0, 1, 2, 3, 4, 5, 9
ROW = "kind int, route long, doc_id long, blob binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("route", pa.int64()), ("doc_id", pa.int64()), ("blob", pa.binary())])
TYPES = {ANCHORS: "u8 u8 i8 i4", COMMON: "u8", COVERS: "i8 i4 i4", ASKS: "i8 i4 u8 i4", STRINGS: "u8 u8 i8 i4"}

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_values = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class WindowHash:
    """Hashes of any window of a byte array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = data.size
        if which not in _powers or _powers[which][0].size < n + 1:
            size = max(n + 1, 1 << 16)
            inverse = np.uint64(pow(int(_BASES[which]), -1, 2**64))
            _powers[which] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)])) for base in (_BASES[which], inverse))
        power, self.back = _powers[which]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_values[which][data] * power[:n], out=self.total[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.total[end] - self.total[begin]) * self.back[begin])

    def every(self, width: int) -> np.ndarray:
        n = self.total.size - width
        return _mix((self.total[width:] - self.total[:n]) * self.back[:n])


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of values[i : i + width] for each i."""
    n, reach = values.size - width + 1, 1
    out = values
    while reach * 2 <= width:
        out = best(out[:-reach], out[reach:])
        reach *= 2
    return best(out[:n], out[width - reach : width - reach + n])


def _pack(kind: int, *arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a.astype(t, copy=False)).tobytes() for a, t in zip(arrays, TYPES[kind].split(), strict=True))


def _unpack(kind: int, blobs: list[bytes]) -> list[np.ndarray]:
    kinds = [np.dtype(t) for t in TYPES[kind].split()]
    each = sum(t.itemsize for t in kinds)
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in kinds]
    for blob in blobs:
        n, at = len(blob) // each, 0
        for t, parts in zip(kinds, out, strict=True):
            parts.append(np.frombuffer(blob, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(parts) for parts in out]


def _route_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(doc ^ (doc >> 17), buckets)


def _dealt(kind: int, route: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, None, bytes]]:
    """Rows of packed arrays, one for each route."""
    if route.size:
        order = np.argsort(route, kind="stable")
        cuts = np.flatnonzero(np.diff(route[order])) + 1
        for part in np.split(order, cuts):
            yield kind, int(route[part[0]]), None, _pack(kind, *(a[part] for a in arrays))


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each document; touching ones become one."""
    if not doc.size:
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    place = np.cumsum(np.append(0, (doc[1:] != doc[:-1]).astype(np.int64))) << 34  # keeps the documents apart
    far = np.maximum.accumulate(end + place)
    new = np.append(True, (begin + place)[1:] > far[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, doc.size - 1)
    return doc[new], begin[new], (far - place)[last]


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(keys[0].size, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings one after another, and where each begins (one more entry: the end)."""
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data and begin[-1] > begin[0] else np.zeros(0, np.uint8), begin - begin[0]


def find_anchors(data: np.ndarray, begin: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors of documents in one array: gram hash, context hash, document's place, position in it."""
    span, reach, n = length - gram + 1, length - gram, data.size
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = WindowHash(data)
    grams = np.maximum(hashed.every(gram), np.uint64(1))
    for end in begin[1:].tolist():
        grams[max(0, end - gram + 1) : end] = _MAX
    least = _sliding(grams, span, np.minimum)
    for end in begin[1:].tolist():
        least[max(0, end - length + 1) : end] = 0
    pad = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(grams == _sliding(np.concatenate([pad, least, pad]), span, np.maximum))
    doc = np.searchsorted(begin, chosen, "right") - 1
    low, high = np.maximum(chosen - reach, begin[doc]), np.minimum(chosen + length, begin[doc + 1])
    context = _mix(hashed(low, high) ^ ((chosen - low) << 32 | (high - low)).astype(np.uint64))
    return grams[chosen], context, doc, chosen - begin[doc]


def prefix_intervals(rows: np.ndarray, size: np.ndarray, place: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeats from the tree of common-prefix intervals of suffixes.

    rows: suffixes as equally wide byte rows, filled up behind their `size`; place: their rank in the order of
    occurrence; left: the byte before each, -1 for none. Yields (length, suffixes) for each interval of common prefixes
    of at least `least` bytes with different left neighbours. Of an inner interval only the earliest suffix is listed
    again in the outer one: its others have just been listed with a longer prefix.
    """
    order = np.argsort(rows.view(f"V{rows.shape[1]}").ravel(), kind="stable")
    above, below = order[:-1], order[1:]
    shared = np.empty(above.size, np.int64)
    for at in range(0, above.size, 8192):
        differs = rows[above[at : at + 8192]] != rows[below[at : at + 8192]]
        shared[at : at + 8192] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    shared = np.minimum(shared, np.minimum(size[above], size[below]))
    shared = np.append(shared, 0).tolist()
    order, left = order.tolist(), left.tolist()
    stack: list[tuple[int, list[int], set[int]]] = []  # common prefix, members, left neighbours (-1 never equals another)
    for k, common in enumerate(shared):
        members, seen = [order[k]], {left[order[k]] if left[order[k]] >= 0 else -1 - order[k]}
        while stack and stack[-1][0] > common:
            length, inner, around = stack.pop()
            inner, around = inner + members, around | seen
            if len(around) > 1:
                yield length, np.asarray(inner)
            members, seen = [min(inner, key=place.__getitem__)], around
        if common < least:
            continue
        if stack and stack[-1][0] == common:
            stack[-1][1].extend(members)
            stack[-1][2].update(seen)
        else:
            stack.append((common, members, seen))


def repeats_in(group: np.ndarray, doc: np.ndarray, at: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered intervals (document, begin, end) among contexts that begin at `at` in their documents, group by group."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.append(0, np.cumsum(size))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    none = np.zeros(0, np.int64)
    starts = np.maximum(size - length + 1, 0)
    if not starts.sum():
        return none, none, none
    owner = np.repeat(np.arange(len(contexts)), starts)
    offset = np.arange(owner.size) - np.repeat(np.cumsum(starts) - starts, starts)
    flat = begin[owner] + offset
    key = WindowHash(data)(flat, flat + length) ^ _mix(group[owner].astype(np.uint64))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    keep = count[back] > 1  # a suffix without an equal start belongs to no interval
    owner, offset, flat = owner[keep], offset[keep], flat[keep]
    if not owner.size:
        return none, none, none
    width = int(size.max())
    padded = np.append(data, np.zeros(width, np.uint8))
    rest = size[owner] - offset
    rows = np.empty((owner.size, 8 + width), np.uint8)
    rows[:, :8] = np.unique(group, return_inverse=True)[1][owner].astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = np.lib.stride_tricks.sliding_window_view(padded, width)[flat]
    rows[:, 8:][np.arange(width) >= rest[:, None]] = 0
    where = at[owner] + offset
    place = np.empty(owner.size, np.int64)
    place[np.lexsort((where, doc[owner]))] = np.arange(owner.size)
    left = np.where(offset > 0, padded[flat - 1].astype(np.int64), -1)
    out: list[tuple[np.ndarray, int]] = []
    for common, members in prefix_intervals(rows, rest + 8, place, left, length + 8):
        ranks = place[members]
        first = members[np.argmin(ranks)]
        later = members[(doc[owner[members]] != doc[owner[first]]) | (where[members] != where[first])]
        if later.size:
            out.append((later, common - 8))
    if not out:
        return none, none, none
    later, reach = np.concatenate([x for x, _ in out]), np.repeat([r for _, r in out], [len(x) for x, _ in out])
    return _merged(doc[owner[later]], where[later], where[later] + reach)


def _rows(found: Iterator[tuple], most: int = 2000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[3])
        if len(held) >= most or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(route, kind, rows) for each run of equal ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        route, kind = batch.column("route").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((route[1:] != route[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(route[a]), int(kind[a]), batch.slice(a, b - a)


def _by_route(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """The blobs of each route by kind."""
    held: dict[int, list[bytes]] = {}
    last = None
    for route, kind, rows in _runs(batches):
        if route != last and held:
            yield held
            held = {}
        last = route
        held.setdefault(kind, []).extend(rows.column("blob").to_pylist())
    if held:
        yield held


def _covers(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, buckets: int) -> Iterator[tuple]:
    doc, begin, end = _merged(doc, begin, end)
    return _dealt(COVERS, _route_of(doc, buckets), doc, begin, end)


def _string_rows(hashes: tuple[np.ndarray, np.ndarray], doc: np.ndarray, at: np.ndarray, buckets: int, length: int, last: bool) -> Iterator[tuple]:
    """Equal strings but for the earliest are covered; the earliest goes on, unless this is the last step."""
    order = np.lexsort((at, doc, hashes[1], hashes[0]))
    first, second, doc, at = hashes[0][order], hashes[1][order], doc[order], at[order]
    new = _first(first, second)
    same = ~new & ~_first(first, second, doc, at)  # one and the same place, met through two anchors
    yield from _covers(doc[~new & ~same], at[~new & ~same], at[~new & ~same] + length, buckets)
    if not last:
        yield from _dealt(STRINGS, (first[new] % np.uint64(buckets)).astype(np.int64), first[new], second[new], doc[new], at[new])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, classes: int = GROUP, classes_in_block: int = GROUP_IN_BLOCK) -> DataFrame:
    """One row a document: doc_id, n_bytes, removed array<struct<begin,end>> (maximal runs of bytes), kept binary."""
    spark = bounded_batches(df)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, reach = tasks, length - gram
    id_type = dict(df.dtypes)[doc_id]
    documents = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pooled(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Packed rows joined to fewer, larger ones: one a kind and route for some megabytes of them."""
        held: dict[tuple[int, int], list[bytes]] = {}
        size = 0

        def out() -> Iterator[tuple]:
            for (kind, route), blobs in held.items():
                yield kind, route, None, _pack(kind, *_unpack(kind, blobs))

        for kind, route, doc, blob in rows:
            if kind == CONTEXTS:
                yield kind, route, doc, blob
                continue
            held.setdefault((kind, route), []).append(blob)
            size += len(blob) + 64
            if size > POOLED:
                yield from out()
                held, size = {}, 0
        yield from out()

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in slices(batches, "text"):
            data, begin = _bytes_of(texts(part))
            ids = part.column("doc_id").to_numpy()
            grams, context, doc, at = find_anchors(data, begin, length, gram)
            doc = ids[doc]
            order = np.lexsort((at, doc, context, grams))
            grams, context, doc, at = grams[order], context[order], doc[order], at[order]
            new = _first(grams, context)
            yield from _covers(doc[~new], at[~new] - reach, at[~new] + length, buckets)
            grams, context, doc, at = grams[new], context[new], doc[new], at[new]
            distinct, count = np.unique(grams, return_counts=True)
            common = np.repeat(count > classes_in_block, count)
            many = distinct[count > classes_in_block]
            yield from _dealt(COMMON, (many % np.uint64(buckets)).astype(np.int64), many)
            yield from _dealt(ASKS, _route_of(doc[common], buckets), doc[common], at[common], grams[common], np.ones(int(common.sum()), np.int32))
            grams, context, doc, at = grams[~common], context[~common], doc[~common], at[~common]
            yield from _dealt(ANCHORS, (grams % np.uint64(buckets)).astype(np.int64), grams, context, doc, at)

    def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for held in _by_route(batches):
            for kind in (COVERS, ASKS):
                for parts in [_unpack(kind, held.get(kind, []))]:
                    yield from _dealt(kind, _route_of(parts[0], buckets), *parts)
            grams, context, doc, at = _unpack(ANCHORS, held.get(ANCHORS, []))
            order = np.lexsort((at, doc, context, grams))
            grams, context, doc, at = grams[order], context[order], doc[order], at[order]
            new = _first(grams, context)
            yield from _dealt(COVERS, _route_of(doc[~new], buckets), doc[~new], at[~new] - reach, at[~new] + length)
            grams, doc, at = grams[new], doc[new], at[new]
            distinct, count = np.unique(grams, return_counts=True)
            many = np.isin(distinct, np.unique(_unpack(COMMON, held.get(COMMON, []))[0])) | (count > classes)
            asks, cut = np.repeat((count > 1) | many, count), np.repeat(many, count)
            yield from _dealt(ASKS, _route_of(doc[asks], buckets), doc[asks], at[asks], grams[asks], cut[asks])

    def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, held, asked = None, {}, None
        for route, kind, rows in _runs(batches):
            if route != last:
                last, held, asked = route, {}, None
            if kind != DOCUMENT:
                held.setdefault(kind, []).extend(rows.column("blob").to_pylist())
                continue
            if asked is None:
                yield from _covers(*_unpack(COVERS, held.get(COVERS, [])), buckets)
                asked = _unpack(ASKS, held.get(ASKS, []))
                order = np.lexsort((asked[1], asked[0]))
                asked, held = [a[order] for a in asked], {}
            for part in slices(iter([rows]), "blob", STEP_BYTES // 4):
                ids = part.column("doc_id").to_numpy()
                low, high = np.searchsorted(asked[0], ids, "left"), np.searchsorted(asked[0], ids, "right")
                wanted = np.flatnonzero(high > low)
                cut: list[tuple[int, np.ndarray, bytes]] = []
                grams, owners, begins, pieces = [], [], [], []
                for i in wanted.tolist():
                    whole = zstandard.decompress(part.column("blob")[i].as_py())
                    span = slice(low[i], high[i])
                    for at, group, many in zip(asked[1][span].tolist(), asked[2][span].tolist(), asked[3][span].tolist(), strict=True):
                        begin = max(at - reach, 0)
                        if many:
                            cut.append((int(ids[i]), begin, whole[begin : at + length]))
                        else:
                            grams.append(group)
                            owners.append(int(ids[i]))
                            begins.append(begin)
                            pieces.append(whole[begin : at + length])
                if cut:
                    size = np.fromiter((len(c[2]) for c in cut), np.int64, len(cut))
                    starts = np.maximum(size - length + 1, 0)
                    owner = np.repeat(np.arange(len(cut)), starts)
                    offset = np.arange(owner.size) - np.repeat(np.cumsum(starts) - starts, starts)
                    flat = (np.cumsum(size) - size)[owner] + offset
                    data = np.frombuffer(b"".join(c[2] for c in cut), np.uint8)
                    hashes = tuple(WindowHash(data, w)(flat, flat + length) for w in (0, 1))
                    yield from _string_rows(hashes, np.array([c[0] for c in cut])[owner], np.array([c[1] for c in cut])[owner] + offset, buckets, length, last=False)
                if pieces:
                    grams = np.array(grams, np.uint64)
                    route_of = (grams % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(route_of, kind="stable")
                    for places in np.split(order, np.flatnonzero(np.diff(route_of[order])) + 1):
                        head = np.array([len(places)], "i8").tobytes() + grams[places].tobytes() + np.array([owners[k] for k in places], "i8").tobytes() + np.array([[begins[k], len(pieces[k])] for k in places], "i4").T.tobytes()
                        yield CONTEXTS, int(route_of[places[0]]), None, zstandard.compress(head + b"".join(pieces[k] for k in places), 1)

    def interval_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for held in _by_route(batches):
            for blob in held.get(COVERS, []):
                parts = _unpack(COVERS, [blob])
                yield from _dealt(COVERS, _route_of(parts[0], buckets), *parts)
            first, second, doc, at = _unpack(STRINGS, held.get(STRINGS, []))
            if doc.size:
                yield from _string_rows((first, second), doc, at, buckets, length, last=True)
            found: list[tuple[int, int, int, bytes]] = []
            for blob in map(zstandard.decompress, held.get(CONTEXTS, [])):
                n = int(np.frombuffer(blob, "i8", 1)[0])
                grams, owner, edges = np.frombuffer(blob, "u8", n, 8), np.frombuffer(blob, "i8", n, 8 + 8 * n), np.frombuffer(blob, "i4", 2 * n, 8 + 16 * n)
                at = 8 + 24 * n
                for k in range(n):
                    size = int(edges[n + k])
                    found.append((int(grams[k]), int(owner[k]), int(edges[k]), blob[at : at + size]))
                    at += size
            found.sort()
            at = 0
            while at < len(found):
                end = min(at + SORTED_AT_ONCE, len(found))
                while end < len(found) and found[end][0] == found[end - 1][0]:
                    end += 1
                group, doc, begin, pieces = zip(*found[at:end], strict=True)
                yield from _covers(*repeats_in(np.array(group, np.uint64), np.array(doc, np.int64), np.array(begin, np.int64), list(pieces), length), buckets)
                at = end

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, covers = None, [], None
        for route, kind, rows in _runs(batches):
            if route != last:
                last, held, covers = route, [], None
            if kind != DOCUMENT:
                held.extend(rows.column("blob").to_pylist())
                continue
            if covers is None:
                covers, held = _merged(*_unpack(COVERS, held)), []
            for part in slices(iter([rows]), "blob", STEP_BYTES // 4):
                ids = part.column("doc_id").to_numpy()
                low, high = np.searchsorted(covers[0], ids, "left"), np.searchsorted(covers[0], ids, "right")
                sizes, removed, kept = [], [], []
                for i, whole in enumerate(map(zstandard.decompress, part.column("blob").to_pylist())):
                    spans = [(max(int(a), 0), min(int(b), len(whole))) for a, b in zip(covers[1][low[i] : high[i]], covers[2][low[i] : high[i]], strict=True)]
                    ends = [0, *(x for s in spans for x in s), len(whole)]
                    sizes.append(len(whole))
                    removed.append([{"begin": a, "end": b} for a, b in spans])
                    kept.append(b"".join(whole[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if spans else whole)
                span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for part in slices(batches, "blob"):
            blobs = [pack(t) for t in part.column("blob").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(blobs, pa.binary())], schema=SCHEMA)

    def step(rows: DataFrame, make) -> DataFrame:
        return rows.repartition(tasks, "route").sortWithinPartitions("route", "kind").mapInArrow(lambda b: _rows(pooled(make(b))), ROW)

    known = documents.filter(F.col("doc_id").isNotNull())
    route = F.pmod(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 17)), F.lit(buckets))
    routed = known.select(F.lit(DOCUMENT).alias("kind"), route.alias("route"), "doc_id", F.col("text").alias("blob")).mapInArrow(compressed, ROW)
    found = known.mapInArrow(lambda b: _rows(pooled(anchor_rows(b))), ROW)
    found = step(found, class_rows)
    found = step(found.unionByName(routed), context_rows)
    found = step(found, interval_rows)
    out = "doc_id long, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary"
    kept = found.unionByName(routed).repartition(tasks, "route").sortWithinPartitions("route", "kind").mapInArrow(kept_rows, out)
    nameless = documents.filter(F.col("doc_id").isNull()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<begin:long,end:long>>)").alias("removed"), F.col("text").cast("binary").alias("kept"))
    return kept.unionByName(nameless).withColumn("doc_id", F.col("doc_id").cast(id_type))
