"""Token ids of many texts at once with a public byte-level BPE tokenizer.

The byte-level pattern cuts a text into pieces whose ids do not depend on their surroundings. Pieces
are found by array operations over the code points of a block; each distinct piece is encoded once by
the tokenizers library and remembered per task, up to `REMEMBER` pieces. Texts that hold the string of
a special token, and tokenizers of another kind, go to the library as they are.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from arbora.llm import spans

BLOCK = 400_000
REMEMBER = 1_500_000
_L, _N, _S, _O = 1, 2, 3, 0

# The endings that the pattern cuts off after a single apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kinds() -> np.ndarray:
    import regex
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        table[i] = _L if c == "L" else _N if c == "N" else _O
    for m in regex.finditer(r"\p{White_Space}", "".join(map(chr, [*range(0x3100)]))):
        table[ord(m[0])] = _S
    return table


def pieces(cp: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the texts of a block of code points."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = kinds[cp]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    head = edge[:n].copy()
    head[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], n)
    first = kind[begin]
    blank = first == _S
    start = np.zeros(n + 1, bool)
    start[begin[blank]] = True
    followed = blank & ~edge[end]
    start[end[followed] - 1] = True
    word = begin[~blank]
    joined = ~edge[word] & (cp[np.maximum(word - 1, 0)] == 32)
    start[word[~joined]] = True
    mark = word[~joined & (cp[word] == 39)]
    mark = mark[(mark + 1 < n)]
    mark = mark[head[mark + 1] & ~edge[mark + 1] & (kind[mark + 1] == _L)]
    for at in mark.tolist():
        tail = "".join(map(chr, cp[at + 1:at + 3]))
        for e in ENDINGS:
            if tail.startswith(e) and not any(edge[at + 2:at + 1 + len(e)]):
                start[at + 1] = False
                stop = at + 1 + len(e)
                if stop < n and not head[stop]:
                    start[stop] = True
                break
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts; one per task."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        before = described.get("pre_tokenizer") or {}
        self.cuts = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and described.get("normalizer") is None
                     and not before.get("add_prefix_space"))
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        self.kinds = _kinds() if self.cuts else None
        self._forget()

    def _forget(self):
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.fresh: dict[int, int] = {}
        self.ids, self.offsets, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def _add(self, hashes: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encode new pieces and return their numbers."""
        done = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(i) for i in done])
        flat = np.fromiter((x for i in done for x in i), np.int32, int(size.sum()))
        used = self.offsets[self.n]
        while used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while self.n + len(size) + 1 > len(self.offsets):
            self.offsets = np.append(self.offsets, np.zeros_like(self.offsets))
        self.ids[used:used + len(flat)] = flat
        self.offsets[self.n + 1:self.n + 1 + len(size)] = used + np.cumsum(size)
        number = np.arange(self.n, self.n + len(size))
        self.n += len(size)
        known, place = np.append(self.known, hashes), np.append(self.place, number)
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], place[order]
        return number

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids per text)."""
        if not self.cuts or any(s in t for t in texts for s in self.special):
            done = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return (np.fromiter((x for i in done for x in i), np.int32), np.array([len(i) for i in done], np.int64))
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.append(0, np.cumsum([len(t) for t in texts]))
        start = pieces(cp, bounds, self.kinds)
        end = np.append(start[1:], len(cp))
        hashes = spans.Prefix(cp).spans(start, end)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        have = np.zeros(len(unique), bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == unique[inside]
        number = np.empty(len(unique), np.int64)
        number[have] = self.place[at[have]]
        new = np.flatnonzero(~have)
        if len(new):
            number[new] = self._add(unique[new], [joined[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        piece = number[inverse]
        size = self.offsets[piece + 1] - self.offsets[piece]
        stop = np.cumsum(size)
        at = np.repeat(self.offsets[piece] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        sums = np.append(0, stop)
        per = np.diff(sums[np.searchsorted(start, bounds)])
        out = self.ids[at]
        if self.n > REMEMBER:
            self._forget()
        return out, per


def encoded(texts: pa.Array, encoder: Encoder, end_id: int | None = 0, limit: int = BLOCK):
    """(first, last, ids, bounds) per block of texts, each text followed by `end_id`."""
    for first, last, data, bounds in spans.blocks(texts, limit):
        ids, per = encoder.block(texts.slice(first, last - first).to_pylist())
        if end_id is not None:
            out = np.full(len(ids) + len(per), end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(per + 1) - 1] = False
            out[keep] = ids
            ids, per = out, per + 1
        yield first, last, ids, np.append(0, np.cumsum(per))
