import random

import numpy as np
import pytest

import corpus_pipeline as cp
from lectura.llm import simhash
from lectura.llm.components import components


def _flipped(rnd, word, bits):
    for b in rnd.sample(range(64), bits):
        word ^= 1 << b
    return word


def _pairs(found):
    """Pairs of nodes that are in a group together."""
    groups = {}
    for key, node in found:
        groups.setdefault(key, set()).add(node)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_first_ring_is_simhash():
    for text in ("a b c d e f g h i j", "word " * 300, "one two", " ".join(f"w{k}" for k in range(700))):
        found = simhash.shingles_of(text.encode())
        bits = [sum(int(h) >> b & 1 for h in found) * 2 > len(found) for b in range(64)]
        rings = simhash.rings_of(found)
        assert rings.size == simhash.RINGS == len(set(rings.tolist())) and int(rings[0]) == sum(1 << b for b, on in enumerate(bits) if on)
    assert simhash.rings_of(simhash.shingles_of(b"A b C d E f")).tolist() == simhash.rings_of(simhash.shingles_of(b"a b c d e f")).tolist()


def test_six_bits_of_a_ring_always_meet():
    rnd = random.Random(2)
    rows, wanted = [], set()
    for k in range(400):
        word, following = rnd.getrandbits(64), rnd.getrandbits(64)
        rows += [(2 * k, word, following), (2 * k + 1, _flipped(rnd, word, 6), _flipped(rnd, following, 20))]
        wanted.add((2 * k, 2 * k + 1))
    rows = np.array(rows, np.uint64)
    met = set()
    for start in range(8):
        for key, node in simhash.ring_groups(rows, start):
            met |= _pairs(zip(key.tolist(), node.tolist(), strict=True))
    assert met == wanted


@pytest.mark.parametrize("n", [30, 90, 400])
def test_groups_under_one_key(n):
    """Crowds under a key, near a middle or in chains, group as links of all pairs do."""
    rnd = random.Random(n)
    head, rows = 0xABCD << 48, []
    while len(rows) < n:
        word, following = head | rnd.getrandbits(48), rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, n // 3])):
            rows.append((len(rows), head | (_flipped(rnd, word, rnd.randrange(8)) & (1 << 48) - 1), _flipped(rnd, following, rnd.randrange(8))))
            if rnd.random() < 0.2:
                word, following = rows[-1][1:]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sum((x ^ y).bit_count() for x, y in zip(rows[a][1:], rows[b][1:], strict=True)) <= 20 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    key, node = next(iter(simhash.ring_groups(np.array(rows, np.uint64), 0, 20)))
    wanted = {(b, a) for a in range(len(rows)) for b in range(a) if root[a] == root[b]}
    assert _pairs(zip(key.tolist(), node.tolist(), strict=True)) == wanted


def test_near_copies_meet_by_their_rings(spark):
    """The stage asks rings alone: all texts 0.8 alike or more meet there, those that aren't alike hardly do."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(300):
        base = [word() for _ in range(rnd.choice([45, 90, 400]))]
        texts.append(" ".join(base))
        texts.append(" ".join(base + [word() for _ in range(len(base) // 4 - 2)]))  # a longer end, close to 0.8
    sets = [simhash.shingles_of(t.encode()) for t in texts]
    alike = [np.intersect1d(a, b).size / np.union1d(a, b).size for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert 0.8 <= min(alike) and max(alike) < 0.86
    rows = [(k, simhash.rings_of(s).view(np.int64).tolist()) for k, s in enumerate(sets)]
    links = simhash.ring_links(spark.createDataFrame(rows, "node long, rings array<long>"))
    met = _pairs((r["root"], r["node"]) for r in components(links).collect())
    wanted = {(k, k + 1) for k in range(0, len(texts), 2)}
    assert len(met & wanted) >= 0.99 * len(wanted) and len(met - wanted) <= 2
    left = cp.keep_one_of_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert {r["doc_id"] for r in left.collect()} == {k for k in range(len(texts))} - {b for _, b in met & wanted}


def test_crowds_get_few_links_under_a_key():
    """A crowd without a middle: links grow with its rows, not with all its pairs."""
    rnd = random.Random(5)
    word, following, rows = rnd.getrandbits(64), rnd.getrandbits(64), []
    for k in range(600):
        word, following = _flipped(rnd, word, 3), _flipped(rnd, following, 3)
        rows += [(2 * k, word, following), (2 * k + 1, _flipped(rnd, word, 12), following)]
    rows = np.array(rows, np.uint64)
    found = simhash._within(rows, 20)
    apart = np.bitwise_count(rows[:, None, 1:] ^ rows[None, :, 1:]).sum(2, dtype=np.int64)
    assert (apart[found[:, 0], found[:, 1]] <= 20).all() and len(found) < 2 * len(rows) < np.sum(apart <= 20) / 2

    def roots(x, y):
        root = np.arange(len(rows))
        while (root[x] != root[y]).any():
            least = np.minimum(root[x], root[y])
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
        return root

    assert (roots(*found.T) == roots(*np.nonzero(apart <= 20))).all()


def test_rings_do_not_repeat_links(spark, monkeypatch):
    """However many keys and rings near copies share, tasks make a few links for each, and the same groups."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = []
    for size in (400, 30, 2, 2):
        base = [word() for _ in range(150)]
        for _ in range(size):
            new = list(base)
            for _ in range(rnd.randrange(3)):
                new[rnd.randrange(150)] = word()
            texts.append(" ".join([*new, word()]))
    rows = [(k, simhash.rings_of(simhash.shingles_of(t.encode())).view(np.int64).tolist()) for k, t in enumerate(texts)]
    made, chained = spark.sparkContext.accumulator(0), simhash._chained

    def counted(batches):
        for batch in chained(batches):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(simhash, "_chained", counted)
    options = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        links = simhash.ring_links(spark.createDataFrame(rows, "node long, rings array<long>")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(texts) - 4 <= made.value <= 20 * len(texts)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame([r[:2] for r in links], "a long, b long")).collect()}
    assert [found[k] for k in range(len(texts))] == [0] * 400 + [400] * 30 + [430] * 2 + [432] * 2
