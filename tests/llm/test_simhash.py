"""Covering SimHash against brute force."""

import itertools

import numpy as np
import pytest
import xxhash

from arbora.llm import simhash
from arbora.llm.catalog import REGISTRY

M = 2**64 - 1


def _plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, radius=4):
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    lowest = {}
    for d, p in rows:
        if d is not None:
            lowest[root(p)] = min(lowest.get(root(p), d), d)
    return sorted([(d, f"{p:016x}", lowest.get(root(p))) for d, p in rows], key=repr)


@pytest.mark.parametrize("free", [M, M ^ 0xFFFF0F0F, 0xFF, 0b1011])
def test_masks_cover_every_small_difference(free):
    places = [i for i in range(64) if free >> i & 1]
    masks = simhash.covering_masks(free, 4)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        some = rng.choice(places, min(4, len(places)), replace=False)
        diff = sum(1 << int(i) for i in some)
        assert any(m & diff == 0 for m in masks)
    assert all(m & ~free == 0 for m in masks)


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_against_all_pairs(spark, crowd):
    """Random prints, chains and a dense ball; small buckets force every level of splitting."""
    rng = np.random.default_rng(7)
    prints = {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)} | {0, M}
    for base in list(prints)[:8]:
        for _ in range(12):
            prints.add(base ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 7)), replace=False)))
    ball = 0x0123456789ABCDEF
    prints |= {ball ^ (1 << i) for i in range(24)} | {ball ^ (1 << i) ^ (1 << i + 1) for i in range(24)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    got = {(r.a & M, r.b & M) for r in simhash.links(df, 4, crowd).distinct().collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(prints, key=simhash._signed), 2) if (a ^ b).bit_count() <= 4}
    assert got == want and len(want) > 500


def test_whole_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = sorted([tuple(r) for r in REGISTRY["op12_simhash"](spark, data).collect()], key=repr)
    want = _components([(r.doc_id, _plain(r.text)) for r in docs])
    assert got == want and sum(d != c for d, _, c in want) > 5


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    long = " ".join(f"Wörd{i % 91}" for i in range(5000))
    texts = [(5, None), (3, ""), (4, " \n\t"), (None, "one two"), (7, "one\x0bTWO"), (8, long), (2, long + " tail"), (2, long + " tail"),
             (9, "x\x1cy\x85z\xa0w v"), (None, "alone here and nowhere else at all")]
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in texts], "doc_id long, text string, print string, root int")
    got = sorted([tuple(r) for r in simhash.near_duplicates(df).collect()], key=repr)
    assert got == _components([(d, _plain(t)) for d, t in texts])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
