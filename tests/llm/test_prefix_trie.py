"""The prefix trie against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from arbora.llm import prefix_trie


def _rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    out = {}
    for c, vs in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + vs[h:]
    return out


def _trie(convs):
    members, ends = {}, {}
    for c in sorted(convs):
        vs = tuple(convs[c])
        for d in range(len(vs) + 1):
            members.setdefault(vs[:d], []).append(c)
        ends.setdefault(vs, []).append(c)
    out = []
    for k, ms in members.items():
        under = [u for u in members if u[:len(k)] == k]
        kids = [u for u in under if len(u) == len(k) + 1]
        leaves = [u for u in under if not any(v[:len(u)] == u and len(v) > len(u) for v in under)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in under if u)
        sha = hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
        out.append((ms[0], len(k), members[k[:-1]][0] if k else None, len(ms), len(kids), len(leaves), saved, sha))
    return sorted(out, key=repr)


def _rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def _conversations(seed, n=60):
    """Shared stretches over several blocks, copies, prefixes of others and splits at every place of a block."""
    rng, rows, made = np.random.default_rng(seed), [], [[("user", f"t{i}") for i in range(14)]]
    for i in range(n):
        base = made[int(rng.integers(0, len(made)))]
        cut = int(rng.integers(0, len(base) + 1))
        tail = [("user" if rng.random() < 0.5 else "bot", "é" * int(rng.integers(0, 4))) for _ in range(int(rng.integers(0, 6)))]
        made.append(base[:cut] + tail if rng.random() < 0.8 else list(base))
    for i, vs in enumerate(made):
        rows += [(7 * i + 3, 10 * p, r, t) for p, (r, t) in enumerate(vs)]
    rng.shuffle(rows)
    return [(int(c), int(t), str(r), str(x)) for c, t, r, x in rows]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, block, stretch, piece", [(1, 4, 1000, 8000), (2, 3, 1, 2)])
def test_trie_against_brute_force(spark, monkeypatch, seed, block, stretch, piece):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = _conversations(seed)
    convs = {}
    for c, t, r, x in sorted(rows):
        convs.setdefault(c, []).append((r, x))
    got = _rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), block=block))
    assert got == _trie(convs)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 3, "user", "b"), (1, 2, None, "a"), (2, None, "", ""), (2, 2, "", "a"), (2, 2, "", "a"), (None, 1, "user", "x"),
            (103, 1, "user", "only"), (205, 0, "user", "deep"), (100, 0, "user", "x" * 30_000), (100, 0, "user", "y"), (199, 5, None, "z")]
    # Conversations with no more turns than their shared head, whose base does not exist, have no turns at all.
    rows += [(c, 0, "user", "gone") for c in range(701, 711)]
    df = spark.createDataFrame([(*r, 5, "n") for r in rows], SCHEMA + ", n int, conv string")
    want = _rebuilt(rows)
    assert any(not v for v in want.values())
    got = _rows(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df))))
    assert got == _trie(want)
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df.limit(0)))).count() == 0
