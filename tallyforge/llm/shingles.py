"""Word shingles of whole texts as 64-bit hashes, a batch of texts at a time, straight from Arrow's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes that are hashed at once (more only for a longer word).
PIECE = 1 << 21

_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; at least n of either."""
    if _powers["n"] < n:
        n = max(n, PIECE + 1)
        for name, base in (("up", _R), ("down", _R_INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def _word_hashes(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; ``fresh``: bytes at which a text starts."""
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = fresh[fresh < len(data)]
    first[edges] = word[edges]
    inner = edges[edges > 0]
    last[inner - 1] = word[inner - 1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64)), at


def _pieces(data: np.ndarray, starts: np.ndarray):
    """Cuts of at most ``PIECE`` bytes that split no word."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + PIECE)
        while b < n and _WORD[data[b]] and _WORD[data[b - 1]]:
            k = np.searchsorted(starts, b)
            if k < len(starts) and starts[k] == b:
                break
            b -= 1
            if b <= a:  # one word longer than a piece
                stop = np.flatnonzero(~_WORD[data[a + PIECE :]])
                b = a + PIECE + int(stop[0]) if len(stop) else n
                later = starts[np.searchsorted(starts, a + 1) :]
                b = min(b, int(later[0])) if len(later) else b
                break
        yield a, b
        a = b


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    starts = (offsets - offsets[0])[:-1]
    hashes, places = [], []
    distinct = np.unique(starts)
    for a, b in _pieces(data, distinct):
        inside = distinct[np.searchsorted(distinct, a) : np.searchsorted(distinct, b)] - a
        h, at = _word_hashes(data[a:b], inside)
        hashes.append(h)
        places.append(at + a)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(places) if places else np.zeros(0, np.int64)
    bounds = np.append(np.searchsorted(where, starts), len(words))
    # an empty text starts where the next one does, so its bounds are equal
    rolled = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled = rolled * _R + words[i : i + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = one * _R + w
            out.append(mix(np.array([one], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
