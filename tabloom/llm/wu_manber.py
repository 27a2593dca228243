"""Wu-Manber multi-pattern search over whole numpy byte buffers.

The classic skip loop moves one pointer through one text.  Here a buffer is
cut into many equal lanes whose pointers advance together, so every step of
the loop is a handful of numpy operations over all lanes.

* block: the last ``b`` bytes of the window under a pointer, hashed;
* shift table: hash -> how far the pointer may move; blocks that occur in no
  pattern prefix move it by the whole window;
* where the shift is 0 the suffix hash names a bucket of patterns, each of
  which is compared with the buffer directly.
"""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_LONG = 24          # patterns from this many bytes on use the long-window tables
_LANE = 2048        # bytes of one lane
_PAD = 16


class _Tables:
    """Shift table and buckets for patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[tuple[int, bytes]], bits: int = 18):
        self.m = min(len(p) for _, p in patterns)
        self.b = min(8, self.m)
        self.bits = np.uint64(64 - bits)
        self.mask = np.uint64((1 << (8 * self.b)) - 1)
        self.shift = np.full(1 << bits, self.m - self.b + 1, np.int32)
        heads = np.frombuffer(b"".join(p[:self.m] for _, p in patterns), np.uint8).reshape(len(patterns), self.m)
        last = None
        for end in range(self.b, self.m + 1):
            v = np.zeros(len(patterns), np.uint64)
            for k in range(self.b):
                v |= heads[:, end - self.b + k].astype(np.uint64) << np.uint64(8 * k)
            last = self._hash(v)
            np.minimum.at(self.shift, last, self.m - end)
        order = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[order], np.arange((1 << bits) + 1)).astype(np.int64)
        self.ids = np.array([patterns[i][0] for i in order], np.int64)
        self.texts = [patterns[i][1] for i in order]
        self.lens = np.array([len(p) for p in self.texts], np.int64)
        # the first bytes of every pattern reject most bucket members before the comparison
        self.head = np.zeros(len(order), np.uint64)
        for k in range(self.b):
            self.head |= heads[order, k].astype(np.uint64) << np.uint64(8 * k)

    def _hash(self, v):
        return ((v * _MULT) >> self.bits).astype(np.int64)

    def search(self, buf: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        m, b = self.m, self.b
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = np.ndarray((n + _PAD - 7,), "<u8", buf, 0, (1,))
        pos = np.arange(m, n + 1, _LANE, dtype=np.int64)      # exclusive window ends
        end = np.minimum(pos + _LANE, n + 1)
        found = []
        while pos.size:
            h = self._hash(words[pos - b] & self.mask)
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                found.append((pos[zero], h[zero]))
            pos = pos + np.maximum(step, 1)
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, h = np.concatenate([f[0] for f in found]) - m, np.concatenate([f[1] for f in found])
        size = self.first[h + 1] - self.first[h]
        which = np.repeat(self.first[h], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        at = np.repeat(at, size)
        keep = ((words[at] & self.mask) == self.head[which]) & (at + self.lens[which] <= n)
        at, which = at[keep], which[keep]
        texts = self.texts
        same = np.fromiter((buf.startswith(texts[w], a) for a, w in zip(at.tolist(), which.tolist())), bool, len(at))
        return at[same], self.ids[which[same]]


class WuManber:
    """All occurrences of many byte patterns in a buffer."""

    def __init__(self, patterns: list[bytes]):
        numbered = [(i, p) for i, p in enumerate(patterns) if p]
        groups = [[x for x in numbered if len(x[1]) < _LONG], [x for x in numbered if len(x[1]) >= _LONG]]
        self.tables = [_Tables(g) for g in groups if g]

    def search(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of every occurrence."""
        padded = buf + b"\0" * _PAD
        parts = [t.search(padded, len(buf)) for t in self.tables]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
