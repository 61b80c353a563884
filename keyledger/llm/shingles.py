"""Word shingles as sorted 64-bit sets, MinHash signatures of them, and exact tests of two sets."""

from __future__ import annotations

import re

import numpy as np
import xxhash

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
PERMS = TREES * DEPTH
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 2**63, PERMS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)

def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
_scale = np.ones((2, 1), np.uint64)


def scales(n: int) -> np.ndarray:
    """Powers of the base up to n, and of its inverse."""
    global _scale
    if _scale.shape[1] > n:
        return _scale
    n = max(n, 1 << 12)
    both = np.array([[BASE], [pow(BASE, -1, 2**64)]], np.uint64)
    out = np.cumprod(np.hstack([np.ones((2, 1), np.uint64), np.repeat(both, n, axis=1)]), axis=1, dtype=np.uint64)
    if n <= 1 << 21:  # longer texts have their own each time
        _scale = out
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number per byte: the same for A-Z and a-z, none for white space.
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BYTES[_SPACE] = 0
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, one after another, and how many each text has.

    Words: A-Z lower-cased, split at the six ASCII white-space characters. All bytes of a piece are hashed at once, in running sums.
    """
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(x) + 1 for x in data])
    joined = b" ".join(data)
    out, places, at = [], [], 0
    while at < len(joined):
        stop = len(joined)
        if stop - at > _PIECE and (m := _BREAK.search(joined, at + _PIECE)):
            stop = m.start()
        raw = np.frombuffer(joined, np.uint8, stop - at, at)
        gaps = np.concatenate([[True], _SPACE[raw], [True]])
        turns = np.flatnonzero(gaps[1:] != gaps[:-1])
        lo, hi = turns[::2], turns[1::2]
        up, down = scales(len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
        out.append(mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)))
        places.append(lo + at)
        at = stop
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(data), np.int64)
    return np.concatenate(out), np.bincount(np.searchsorted(ends, np.concatenate(places), "right"), minlength=len(data))


def shingled(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word shingles in order; the whole sequence as one if it is shorter; none without words."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * _M3 + h[i : len(h) - k + 1 + i])
    return out


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    h, counts = word_hashes(texts)
    return [np.unique(shingled(x, n)) for x in np.split(h, np.cumsum(counts)[:-1])]


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash of a set that isn't empty: 128 values of 32 bits."""
    least = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):  # pieces that stay in the CPU's cache, however long the text
        least = np.minimum(least, (_A[:, None] * s[None, i : i + 512] + _B[:, None]).min(axis=1))
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def sketch(sig: np.ndarray) -> bytes:
    """The lowest bit of each MinHash value, 16 bytes: two sets agree in (1 + Jaccard) / 2 of the bits, give or take 5 %."""
    return np.packbits((sig & 1).astype(np.uint8)).tobytes()


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: equal sets have equal digests."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Jaccard of num / den or more, in whole numbers."""
    both = common(a, b)
    return den * both >= num * (len(a) + len(b) - both) and both > 0
