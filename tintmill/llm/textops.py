"""Vectorised words and word n-gram hashes over a batch of texts."""

from __future__ import annotations

import ctypes
import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Seeds and odd multipliers of the two families of word and window hashes.
_SEED = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LEFT = (0xC2B2AE3D27D4EB4F, 0x8CB92BA72F3D8DD7)
_RIGHT = (0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Words up to so many bytes are hashed by vectors of eight bytes, longer ones by a cryptographic digest.
_LONG = 64
#: Words that are hashed at a time.
_RUN = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a list of texts (None counts as empty), laid out one after another.

    ``first``: index of each text's first word, with the total at the end; ``doc``: the text of each
    word; ``starts``/``ends``: byte places in ``blob``.
    """

    def __init__(self, texts: list, lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.blob = b"\n".join(raw) + b"\n"
        b = np.frombuffer(self.blob, np.uint8)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        self.bytes = b
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
        self.starts, self.ends = edge[0::2], edge[1::2]
        if len(self.starts) > len(self.ends):
            self.starts = self.starts[: len(self.ends)]
        length = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
        begin = np.concatenate([[0], np.cumsum(length)])
        self.first = np.searchsorted(self.starts, begin).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes.

        Eight bytes at a time are mixed into the state by a bijection, so words of at most eight bytes
        and equal length never collide, and the algebra of sums and powers gives no colliding families.
        """
        out, pad = np.empty(len(self.starts), np.uint64), np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(pad) - 7, "<u8", pad.data, strides=(1,))
        for a in range(0, len(out), _RUN):
            starts, size = self.starts[a : a + _RUN], self.ends[a : a + _RUN] - self.starts[a : a + _RUN]
            h = mix(size.astype(np.uint64) + np.uint64(_SEED[which]))
            todo, done = np.flatnonzero(size <= _LONG), 0
            while len(todo):
                left = size[todo] - done
                value = lanes[starts[todo] + done]
                value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
                h[todo] = mix((h[todo] ^ value) * np.uint64(_LEFT[which]))
                todo, done = todo[left > 8], done + 8
            for k in np.flatnonzero(size > _LONG).tolist():
                h[k] = int.from_bytes(hashlib.blake2b(self.bytes[starts[k] : starts[k] + size[k]], digest_size=8, person=bytes([which])).digest(), "little")
            out[a : a + _RUN] = h
        return out

    def digests(self) -> np.ndarray:
        """Two 64-bit halves of a cryptographic digest of each text's word sequence (its words joined by spaces); 0, 0 without words."""
        b = self.bytes
        keep = np.zeros(len(b) + 1, bool)
        mark = np.zeros(len(b) + 1, np.int8)
        mark[self.starts], mark[self.ends] = 1, -1
        keep[: len(b)] = np.cumsum(mark[: len(b)], dtype=np.int8) > 0
        keep[self.ends] = True
        place = np.cumsum(keep) - 1
        plain = np.where(mark[: len(b)] < 0, np.uint8(32), b)[keep[: len(b)]]
        out = np.zeros((len(self.count), 2), np.uint64)
        full = np.flatnonzero(self.count)
        begin, end = place[self.starts[self.first[:-1][full]]], place[self.ends[self.first[1:][full] - 1]]
        for d, x, y in zip(full.tolist(), begin.tolist(), end.tolist()):
            out[d] = np.frombuffer(hashlib.blake2b(plain[x:y], digest_size=16).digest(), "<u8")
        return out


class Block:
    """A block's documents by id and text, whose words are laid out a part at a time.

    A part holds about ``limit`` characters (a longer text is alone), so the arrays over words don't
    grow with the block. The last part laid out is kept, so a block of one part is laid out once.
    """

    def __init__(self, ids: list, texts: list, order: list[int], lower: bool = False, limit: int = 3 << 22):
        self.order, self.lower, self._last = order, lower, (-1, None)
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        upto = np.cumsum([len(t or "") for t in self.texts], dtype=np.int64)
        cuts = [0]
        while cuts[-1] < len(self.texts):
            a = cuts[-1]
            cuts.append(max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, "right"))))
        #: First and last document of each part; a block without documents has one part of none.
        self.parts = list(zip(cuts[:-1], cuts[1:])) or [(0, 0)]

    def words(self, k: int) -> Words:
        if self._last[0] != k:
            self._last = (-1, None)
            a, b = self.parts[k]
            self._last = (k, Words(self.texts[a:b], self.lower))
        return self._last[1]

    def forget(self) -> None:
        """Lets the part that was laid out last go."""
        self._last = (-1, None)


def joined(x: np.ndarray, y: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the sequence x then y, from the hashes of both."""
    z = (x * np.uint64(_LEFT[which])) ^ ((y + np.uint64(_SEED[which])) * np.uint64(_RIGHT[which]))
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def ngrams(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of every n consecutive words, by their first word, ignoring text borders: halves are joined, by doubling."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(size, np.uint64)
    for a in range(0, size, _RUN):
        power, width, own, length = hashes[a : min(a + _RUN, size) + n - 1], 1, None, 0
        while True:
            if n & width:
                # What the lower bits of n have covered stands first, the next power of two after it.
                own = power if own is None else joined(own[: len(power) - length], power[length:], which)
                length += width
            if length == n:
                break
            power, width = joined(power[:-width], power[width:], which), 2 * width
        out[a : a + _RUN] = own[: min(_RUN, size - a)]
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Indices of the first words of n-grams that stay within their text."""
    count = np.diff(first)
    keep = np.zeros(max(total, 0), bool)
    mark = np.zeros(total + 1, np.int64)
    ok = count >= n
    np.add.at(mark, first[:-1][ok], 1)
    np.add.at(mark, first[:-1][ok] + count[ok] - n + 1, -1)
    keep = np.cumsum(mark[:total]) > 0
    return np.flatnonzero(keep)


def deltas(values: np.ndarray) -> bytes:
    """Ascending unsigned values as variable-length byte groups of their differences."""
    if not len(values):
        return b""
    d = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    need = np.ones(len(d), np.int64)
    for bits in range(7, 64, 7):
        if not (more := d >= np.uint64(1 << bits)).any():
            break
        need += more
    end = np.cumsum(need)
    out = np.zeros(int(end[-1]), np.uint8)
    at = end - need
    for k in range(int(need.max())):
        has = need > k
        part = ((d[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[at[has] + k] = part | np.where(need[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def undeltas(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(begin, last - begin + 1)
    part = (b & 127).astype(np.uint64) << (place.astype(np.uint64) * np.uint64(7))
    return np.cumsum(np.add.reduceat(part, begin), dtype=np.uint64)


def release() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(column: pa.Array, limit: int = 1 << 20):
    """(begin, end, texts) for runs of a column that hold about ``limit`` bytes each (a longer text is alone)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, "right")))
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b
