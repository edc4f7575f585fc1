"""Vectorised kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = 0x9E3779B97F4A7C55
STEP = U64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class _Powers:
    """Powers of the base modulo 2**64 and their inverses, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(base: int) -> np.ndarray:
                out = np.full(n, base & (2**64 - 1), U64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = run(_BASE), run(pow(_BASE, -1, 2**64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


#: Bytes whose words are hashed at once; a longer word is hashed whole.
PIECE = 1 << 18


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word; document i is data[offsets[i]:offsets[i + 1]]."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid
    ends[:-1] &= ~np.append(solid[1:], False)[: len(data) - 1] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(first), U64)
    at = 0
    while at < len(first):
        # whole words, as a word's hash does not depend on where it stands
        stop = max(at + 1, int(np.searchsorted(last, first[at] + PIECE, "right")))
        hashes[at:stop] = _hashed(data[first[at] : last[stop - 1]], first[at:stop] - first[at], last[at:stop] - first[at])
        at = stop
    return hashes, np.searchsorted(offsets, first, "right") - 1


def _hashed(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words data[first:last]."""
    up, down = _POWERS.upto(len(data) + 1)
    run = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * up[:-1], out=run[1:])
    return mixed((run[last] - run[first]) * down[first] + (last - first).astype(U64) * STEP)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; nulls are empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
