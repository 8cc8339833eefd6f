"""Adaptive context-mixing range coder for token ids, many independent blocks side by side.

A block holds `STEPS` ids and is coded from a fresh state, so blocks need nothing of each other; each
carries the CRC-32 of its ids. For every id three predictions are mixed into one distribution over
2**24 units: the id that last followed the two ids before (order 2), the id that last followed the one
before (order 1), and adaptive counts of id groups (order 0). The shares of orders 1 and 2 follow how
often they were right. A carry-less 64-bit range coder with 32-bit words codes the id in one step.

All blocks of a segment advance in lock-step as numpy arrays; a block is one row of each state array.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

STEPS = 1024
MAGIC = b"CMR1"
GROUPS, UNIT, REFRESH = 256, 1 << 14, 32
TOTAL_BITS, ORDER0_BITS = 24, 22

_M = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


class _Model:
    def __init__(self, lanes: int):
        self.row = np.arange(lanes)
        self.one = np.full((lanes, 1024), -1, np.int32)
        self.two = np.full((lanes, 2048), -1, np.int32)
        self.trust1 = np.full(lanes, 8192, np.int64)
        self.trust2 = np.full(lanes, 16384, np.int64)
        self.counts = np.ones((lanes, GROUPS), np.int64)
        self.a = np.zeros(lanes, np.int64)
        self.b = np.zeros(lanes, np.int64)
        self.step = 0

    def shrink(self, lanes: int):
        for k, v in vars(self).items():
            if isinstance(v, np.ndarray):
                setattr(self, k, v[:lanes])

    def predict(self):
        if self.step % REFRESH == 0:
            share = 1 + self.counts * (UNIT - GROUPS) // self.counts.sum(axis=1, keepdims=True)
            self.cum = np.zeros((len(self.row), GROUPS + 1), np.int64)
            np.cumsum(share, axis=1, out=self.cum[:, 1:])
            self.cum[:, GROUPS] = UNIT
        self.h1 = (self.a * 40503 >> 3) & 1023
        self.h2 = (self.a * 40503 + self.b * 30011 >> 3) & 2047
        self.p1, self.p2 = self.one[self.row, self.h1].astype(np.int64), self.two[self.row, self.h2].astype(np.int64)
        self.w1 = np.where(self.p1 >= 0, self.trust1 << 6, 0)
        self.w2 = np.where(self.p2 >= 0, self.trust2 << 7, 0)
        self.w0 = (1 << TOTAL_BITS) - self.w1 - self.w2

    def order0(self, ids: np.ndarray):
        """Start and size of the order-0 part of each id."""
        group = ids >> 8
        start = self.cum[self.row, group]
        size = self.cum[self.row, group + 1] - start
        at = (start << 8) + (ids & 255) * size
        low = self.w0 * at >> ORDER0_BITS
        return low, (self.w0 * (at + size) >> ORDER0_BITS) - low

    def interval(self, ids: np.ndarray):
        low, size = self.order0(ids)
        low = low + self.w1 * (self.p1 < ids) + self.w2 * (self.p2 < ids)
        return low, size + self.w1 * (self.p1 == ids) + self.w2 * (self.p2 == ids)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The id whose interval holds unit `v`."""
        swap = self.p1 > self.p2
        pa, pb = np.where(swap, self.p2, self.p1), np.where(swap, self.p1, self.p2)
        wa, wb = np.where(swap, self.w2, self.w1), np.where(swap, self.w1, self.w2)
        same = pa == pb
        wa, wb = np.where(same, wa + wb, wa), np.where(same, 0, wb)
        la, sa = self.order0(np.maximum(pa, 0))
        lb, sb = self.order0(np.maximum(pb, 0))
        hit_a = (wa > 0) & (v >= la) & (v < la + sa + wa)
        v1 = np.where((wa > 0) & (v >= la + wa), v - wa, v)
        hit_b = ~hit_a & (wb > 0) & (v1 >= lb) & (v1 < lb + sb + wb)
        v2 = np.where((wb > 0) & (v1 >= lb + wb), v1 - wb, v1)
        at = (((v2 + 1) << ORDER0_BITS) - 1) // self.w0
        unit = at >> 8
        group = np.zeros(len(v), np.int64)
        for k in (128, 64, 32, 16, 8, 4, 2, 1):
            group += k * (self.cum[self.row, group + k] <= unit)
        start = self.cum[self.row, group]
        ids = (group << 8) + np.minimum((at - (start << 8)) // (self.cum[self.row, group + 1] - start), 255)
        return np.where(hit_a, pa, np.where(hit_b, pb, ids))

    def learn(self, ids: np.ndarray):
        for p, name in ((self.p1, "trust1"), (self.p2, "trust2")):
            t = getattr(self, name)
            move = np.where(p == ids, (65535 - t) >> 4, -(t >> 4))
            setattr(self, name, t + np.where(p >= 0, move, 0))
        self.one[self.row, self.h1] = ids
        self.two[self.row, self.h2] = ids
        self.counts[self.row, ids >> 8] += 24
        self.a, self.b = ids, self.a
        self.step += 1


def _renew(low: np.ndarray, size: np.ndarray):
    """Blocks that must move on by a word, and their cut-off ranges."""
    go = np.flatnonzero(size <= _M)
    l, s = low[go], size[go]
    crosses = (l >> _32) != ((l + s - np.uint64(1)) >> _32)
    size[go] = np.where(crosses, (_M - (l & _M)) + np.uint64(1), s) << _32
    low[go] = (l & _M) << _32
    return go, l >> _32


def encode(ids: np.ndarray) -> bytes:
    """One segment: header, then per block its CRC-32, number of words and words."""
    n = len(ids)
    lanes = -(-n // STEPS)
    grid = np.zeros(lanes * STEPS, np.int64)
    grid[:n] = ids
    grid = grid.reshape(lanes, STEPS)
    tail = n - (lanes - 1) * STEPS
    model = _Model(lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words = np.zeros((lanes, STEPS + 2), np.uint32)
    used = np.zeros(lanes, np.int64)
    ends = (low, size)
    for step in range(STEPS if lanes else 0):
        if step == tail:
            ends = (low, size)
            low, size = low[:-1].copy(), size[:-1].copy()
            model.shrink(lanes - 1)
            if lanes == 1:
                break
        now = grid[:len(low), step]
        model.predict()
        start, width = model.interval(now)
        unit = size >> np.uint64(TOTAL_BITS)
        low += unit * start.astype(np.uint64)
        size = unit * width.astype(np.uint64)
        go, word = _renew(low, size)
        words[go, used[go]] = word
        used[go] += 1
        model.learn(now)
    if lanes:
        last = np.append(low, ends[0][-1:]) if len(low) < lanes else low
        row = np.arange(lanes)
        words[row, used] = last >> _32
        words[row, used + 1] = last & _M
    used += 2
    crc = [zlib.crc32(grid[i, :STEPS if i < lanes - 1 else tail].astype("<u4").tobytes()) for i in range(lanes)]
    head = MAGIC + struct.pack("<II", n, STEPS) + np.array(crc, "<u4").tobytes() + used.astype("<u4").tobytes()
    return head + words[np.arange(STEPS + 2) < used[:, None]].astype("<u4").tobytes()


def decode(raw: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError when a block's checksum does not fit."""
    if raw[:4] != MAGIC:
        raise ValueError("not a coded segment")
    n, steps = struct.unpack("<II", raw[4:12])
    lanes = -(-n // steps)
    crc = np.frombuffer(raw, "<u4", lanes, 12)
    used = np.frombuffer(raw, "<u4", lanes, 12 + 4 * lanes).astype(np.int64)
    words = np.append(np.frombuffer(raw, "<u4", int(used.sum()), 12 + 8 * lanes), np.zeros(2, np.uint32)).astype(np.uint64)
    at = np.cumsum(used) - used
    tail = n - (lanes - 1) * steps
    grid = np.zeros((lanes, steps), np.int64)
    model = _Model(lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code = (words[at] << _32) | words[at + 1]
    at = at + 2
    for step in range(steps if lanes else 0):
        if step == tail:
            low, size, code, at = low[:-1].copy(), size[:-1].copy(), code[:-1].copy(), at[:-1].copy()
            model.shrink(lanes - 1)
            if lanes == 1:
                break
        model.predict()
        unit = size >> np.uint64(TOTAL_BITS)
        v = np.minimum((code - low) // unit, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
        ids = np.minimum(model.find(v), 65535)
        start, width = model.interval(ids)
        low += unit * start.astype(np.uint64)
        size = unit * width.astype(np.uint64)
        go, _ = _renew(low, size)
        code[go] = ((code[go] & _M) << _32) | words[np.minimum(at[go], len(words) - 1)]
        at[go] += 1
        grid[:len(low), step] = ids
        model.learn(ids)
    for i in range(lanes):
        if zlib.crc32(grid[i, :steps if i < lanes - 1 else tail].astype("<u4").tobytes()) != crc[i]:
            raise ValueError(f"block {i} is damaged")
    return grid.ravel()[:n]
