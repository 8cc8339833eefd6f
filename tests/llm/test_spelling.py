"""Spelling variants against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arbora.llm import spelling


def _near(a, b):
    """Exactly one edit, by deletions."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    cut = lambda w: {(i, w[:i] + w[i + 1:]) for i in range(len(w))}
    if len(a) == len(b):
        return bool(cut(a) & cut(b))
    short, long = sorted((a, b), key=len)
    return short in {w for _, w in cut(long)}


def _variants(counts):
    words, out = sorted(counts), {}
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if _near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in words:
        top = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= 2 * counts[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def _words(rng, n):
    made = set()
    while len(made) < n:
        size = int(rng.integers(1, 12))
        w = "".join(rng.choice(list("abéÿ"), size))
        made |= {w, w[:-1] + "a", "b" + w, w[:size // 2] + w[size // 2 + 1:]} - {""}
    return sorted(made)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_variants_against_all_pairs(spark, crowd):
    """Short alphabets, all lengths, both directions; small groups force splits until only two places are free."""
    rng = np.random.default_rng(5)
    counts = {w: int(rng.integers(3, 200)) for w in _words(rng, 400)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = spelling.near_words(df, crowd).collect()
    got = Counter((min(r.a, r.b), max(r.a, r.b)) for r in pairs)
    assert set(got) == {(a, b) for a, b in itertools.combinations(sorted(counts), 2) if _near(a, b)}
    assert max(got.values()) == 1 and all(counts[r.a] == r.n_a and counts[r.b] == r.n_b for r in pairs)
    if crowd == 3:
        return
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    assert found == _variants(counts)


def test_scan_in_slices(monkeypatch):
    monkeypatch.setattr(spelling, "QUERIES", 7)
    words = _words(np.random.default_rng(2), 120)
    words = sorted(w for w in words if len(w) > 1)
    group = np.cumsum([0] + [a[0] != b[0] for a, b in zip(words, words[1:])])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.array([len(w) for w in words])
    i, j = spelling.scan(codes, np.cumsum(size) - size, size, group, 1)
    want = {(a, b) for a, b in itertools.combinations(range(len(words)), 2) if words[a][0] == words[b][0] and _near(words[a], words[b])}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_vocabulary_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    long = "x" * 20_000
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "Größe Größe größe×÷ ÀÀÀÀÀ"), (4, f"{long} {long} {long}y"), (4, "Straße, straße; STRAßE"),
            (4, "Straße, straße; STRAßE"), (5, "漢字 l’été-là Straßen")]
    rows += [(i, "Greater Freater freaters") for i in range(100, 300)]
    df = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows], "doc_id long, text string, word string, n int, form int")
    want = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            r = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 97 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            want[r] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    words = spelling.vocabulary(df, damage_every=97)
    assert {r.word: r.n for r in words.collect()} == want and len(want) == 4
    assert {r.word: tuple(r)[1:] for r in spelling.variants(words).collect()} == _variants(want)
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0
