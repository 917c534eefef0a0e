"""Vectorised word hashing for Arrow string columns (numpy inside Spark tasks).

Texts are read straight from the Arrow buffers.  A word is a maximal run of
word bytes (a 256-entry class table); its 64-bit hash comes from prefix sums of
a polynomial over its bytes, so no Python string is made per word.  Work goes
in pieces of a few MB, so memory follows the longest single text at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_EXACT = _RNG.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (_RNG.randint(0, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1))]

#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if which == "up" else _INV, np.uint64)
        step[0] = 1
        have = _powers[which] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, not copied where it has no
    nulls; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(off, wide)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def row_groups(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _piece(data: np.ndarray, cuts: np.ndarray, member: np.ndarray, fold: bool):
    """Word hashes, starts and ends of one piece; ``cuts`` are row starts."""
    n = len(data)
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    edge[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE if fold else _EXACT)[data] * _power("up", n), dtype=np.uint64, out=sums[1:])
    h = (sums[e + 1] - sums[s]) * _power("down", n)[s]
    return mix(h + (e - s).astype(np.uint64)), s, e + 1


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray = ALNUM, fold: bool = True, limit: int = 1 << 20):
    """Word hashes of rows ``off`` and the row offsets into them.

    Also returns the words' byte spans in ``data``.  A text longer than
    ``limit`` is cut between words.
    """
    hashes, starts, ends = [], [], []
    base, end = int(off[0]), int(off[-1])
    p = base
    while p < end:
        q = min(p + limit, end)
        while q < end and member[data[q - 1]] and member[data[q]]:
            more = np.flatnonzero(~member[data[q: q + 4096]])
            q = q + int(more[0]) if len(more) else min(q + 4096, end)
        cuts = off[np.searchsorted(off, p): np.searchsorted(off, q)] - p
        h, s, e = _piece(data[p:q], cuts, member, fold)
        hashes.append(h)
        starts.append(s + p)
        ends.append(e + p)
        p = q
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, off).astype(np.int64), starts, np.concatenate(ends)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (across rows too; callers drop those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _STEP[0]
    for j in range(1, k):
        out += h[j: j + n] * _STEP[j]
    return mix(out)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles by row, and row offsets.  A row of fewer
    words, but not none, has one shingle of all its words."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(to[-1]), np.uint64)
    full = windows(h, k)
    rows = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(out)) - to[rows] + off[rows]
    whole = n[rows] >= k
    out[whole] = full[at[whole]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        w = h[off[i]: off[i + 1]]
        out[to[i]] = mix(np.array([sum(int(x) * int(_STEP[j]) for j, x in enumerate(w)) + len(w) & (1 << 64) - 1], np.uint64))[0]
    return out, to
