"""Vectorised words of many texts: positions, hashes and window hashes with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D.  UTF-8 continuation
and lead bytes are never white space, so byte positions and code points agree.
"""

from __future__ import annotations

import numpy as np
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
BLOCK = 1 << 21  # bytes hashed at a time, so that the work arrays stay small
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, first): word i is buffer[starts[i]:ends[i]]; text t owns words first[t]:first[t+1]."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    inside = np.empty(len(buf) + 1, bool)
    inside[0] = False
    np.logical_not(SPACE[buf], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.zeros(len(texts) + 1, np.int64)
    first[1:] = np.searchsorted(starts, np.cumsum(sizes))
    return buf, starts, ends, first


POSITIONS = 64  # bytes of a word hashed by table; longer words are hashed by xxh3
_tables: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    """A pseudo-random value for every (position, byte)."""
    if seed not in _tables:
        _tables[seed] = mix(mix(np.arange(1, POSITIONS * 256 + 1, dtype=U) * BASES[seed]) + BASES[1 - seed])
    return _tables[seed]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word: tabulation over (position, byte), xxh3 beyond POSITIONS bytes."""
    out = np.empty(len(starts), U)
    table = _table(seed)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + BLOCK, "right")), i + 1)
        hi = int(ends[j - 1])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        place = np.arange(hi - lo, dtype=np.int32)
        place -= np.repeat(s.astype(np.int32), np.diff(np.append(s, hi - lo)))
        np.minimum(place, POSITIONS - 1, out=place)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(table[(place << 8) | buf[lo:hi]], out=sums[1:])
        out[i:j] = mix(sums[e] - sums[s] + (e - s).astype(U))
        i = j
    for k in np.flatnonzero(ends - starts > POSITIONS).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]], seed=seed + 1)
    return out


PART = 1 << 17  # words compared at a time
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], U)


def _eight(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number (zeros beyond the end)."""
    whole = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))
    inside = at < len(whole)
    if inside.all():
        return whole[at]
    tail = np.zeros(16, np.uint8)
    first = max(len(buf) - 8, 0)
    tail[: len(buf) - first] = buf[first:]
    rest = np.ndarray((9,), "<u8", tail, strides=(1,))
    out = np.empty(len(at), "<u8")
    out[inside] = whole[at[inside]]
    out[~inside] = rest[at[~inside] - first]
    return out


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_start:a_start+size] equals b[b_start:b_start+size], for each."""
    out = np.ones(len(size), bool)
    for k in np.flatnonzero(size > 512).tolist():
        out[k] = a[a_start[k] : a_start[k] + size[k]].tobytes() == b[b_start[k] : b_start[k] + size[k]].tobytes()
    todo, done = np.flatnonzero((size > 0) & (size <= 512)), 0
    while len(todo):
        left = size[todo] - done
        differs = ((_eight(a, a_start[todo] + done) ^ _eight(b, b_start[todo] + done)) & _MASKS[np.minimum(left, 8)]) != 0
        out[todo[differs]] = False
        todo, done = todo[~differs & (left > 8)], done + 8
    return out


class WordTable:
    """Numbers for distinct words, exact: found by hash, then compared byte by byte.

    A word whose hash belongs to another one is kept in a dictionary of its own.  A table that
    would hold more than ``limit`` words starts anew (``cleared`` counts how often)."""

    def __init__(self, limit: int):
        self.limit, self.cleared = limit, 0
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.empty(0, U), np.empty(0, np.int32)
        self.start, self.size, self.bytes = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8)
        self.others: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.size)

    def _add(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        until = np.cumsum(size) - size
        self.start, self.size = np.concatenate([self.start, len(self.bytes) + until]), np.concatenate([self.size, size.astype(np.int32)])
        self.bytes = np.concatenate([self.bytes, buf[np.repeat(starts - until, size) + np.arange(int(size.sum()))]])

    def _holds(self, number: np.ndarray, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words are the numbers' own."""
        own = self.size[number]
        return (own == size) & same_bytes(buf, starts, self.bytes, self.start[number], np.minimum(size, own))

    def number(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(each word's number, positions of the words that were new, in the order of their numbers)."""
        hashes = word_hashes(buf, starts, ends) if hashes is None else hashes
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self) and len(self) + len(distinct) > self.limit:
            self._clear()
            self.cleared += 1
        slot = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[slot] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        numbers = np.empty(len(distinct), np.int32)
        numbers[known] = self.entry[slot[known]]
        new = index[~known]
        numbers[~known] = len(self) + np.arange(len(new))
        if len(new):
            self._add(buf, starts[new], ends[new] - starts[new])
            place = np.searchsorted(self.keys, distinct[~known])
            self.keys, self.entry = np.insert(self.keys, place, distinct[~known]), np.insert(self.entry, place, numbers[~known])
        found, size = numbers[inverse], ends - starts
        del inverse
        other = np.concatenate([i + np.flatnonzero(~self._holds(found[i : i + PART], buf, starts[i : i + PART], size[i : i + PART]))
                                for i in range(0, max(len(found), 1), PART)])
        more = []
        for i in other.tolist():
            word = buf[starts[i] : ends[i]].tobytes()
            if word not in self.others:
                self.others[word] = len(self) + len(more)
                more.append(i)
            found[i] = self.others[word]
        if more:
            self._add(buf, starts[more], size[more])
        return found, np.concatenate([new, np.array(more, np.int64)])


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words; position i is the run that starts there."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U)
    acc = words[:n].copy()
    for k in range(1, width):
        acc *= BASES[1 - seed]
        acc += words[k : k + n]
    return mix(acc)


def inside_one_text(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n windows of ``width`` words stay inside one text."""
    ok = np.ones(max(n, 0), bool)
    for cut in range(1, width):  # windows starting ``cut`` words before a text's first word cross into it
        at = first[1:-1] - cut
        ok[at[(at >= 0) & (at < n)]] = False
    # a text shorter than the width may start before the previous cut; its windows are covered above
    return ok
