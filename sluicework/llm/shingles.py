"""Hashed word-shingle sets of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                a = np.full(m, base, U)
                a[0] = 1
                with np.errstate(over="ignore"):
                    setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, len + 1 offsets); null is empty."""
    c = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]] if c.buffers()[2] is not None and len(c) else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer text is a range of its own."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, len(off) - 1)
        lo = hi


def slices(batch: pa.RecordBatch, at: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices with about ``most`` bytes of text in column ``at``; a longer text is a slice of its own."""
    for lo, hi in chunks(flat_bytes(batch.column(at))[1], most):
        yield batch.slice(lo, hi - lo)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text one after another, len + 1 offsets).

    A-Z count as a-z.  A shingle is n consecutive words; a text of fewer words is one shingle.
    """
    docs = len(off) - 1
    if not len(data):
        return np.zeros(0, U), np.zeros(docs + 1, np.int64)
    with np.errstate(over="ignore"):
        low = _LOWER[data]
        gap = _SPACE[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before = np.concatenate(([True], gap[:-1])) | edge[:-1]
        after = np.concatenate((gap[1:], [True])) | edge[1:]
        start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        up, down = _Powers.of(len(data))
        total = np.concatenate((np.zeros(1, U), np.cumsum((low.astype(U) + U(1)) * up)))
        word = mix((total[end] - total[start]) * down[start])
        owner = np.searchsorted(off, start, side="right") - 1
        words = np.bincount(owner, minlength=docs)
        if len(word) >= n:
            h = sum(word[k : len(word) - n + 1 + k] * _ODD[k] for k in range(n))
            whole = owner[: len(word) - n + 1] == owner[n - 1 :]
            h, who = mix(h[whole]), owner[: len(word) - n + 1][whole]
        else:
            h, who = np.zeros(0, U), np.zeros(0, np.int64)
        first = np.concatenate(([0], np.cumsum(words)))[:-1]
        for m in range(1, n):
            few = np.flatnonzero(words == m)
            if len(few):
                s = sum(word[first[few] + k] * _ODD[k] for k in range(m)) + U(m)
                h, who = np.concatenate((h, mix(s))), np.concatenate((who, few))
        if len(who) and np.any(who[1:] < who[:-1]):
            order = np.argsort(who, kind="stable")
            h, who = h[order], who[order]
    cut = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=docs))))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if z - a > 1:
            h[a:z].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(who[new], minlength=docs))))
