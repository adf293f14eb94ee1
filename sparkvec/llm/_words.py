"""Vectorised word splitting and hashing over Arrow string batches.

A batch is handled as one byte buffer: word starts and ends come from a byte
class table, and a word's 64-bit hash reads eight of its bytes at a time.  No
Python object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U)

#: Words `[^\x20\x09-\x0D]+`: every byte but the six white-space characters.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and whatever is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and each text's bounds; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(bounds):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(batch: pa.RecordBatch, column: str, most: int):
    """Slices of a batch with about ``most`` bytes of text; every row is in one of them."""
    if not batch.num_rows:
        return
    _, bounds = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        to = min(to, batch.num_rows, at + 50_000)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of some texts: ``data[starts[i]:ends[i]]``; text d has words first[d] to first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    _padded: np.ndarray | None = None

    def hashes(self, which: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """64-bit hashes of all words, or of those with the indices ``which``."""
        if self._padded is None:
            self._padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=self._padded.data, strides=(1,))
        starts, ends = (self.starts, self.ends) if which is None else (self.starts[which], self.ends[which])
        size = ends - starts
        h = mix(size.astype(U) + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64)))
        live, at = np.arange(len(size)), 0
        while len(live):
            part = eights[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
            h[live] = mix((h[live] ^ part) * U(0x9FB21C651E98DF25) + U(at + 1))
            at += 8
            live = live[size[live] > at]
        return h

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(bounds), np.int64))
    inside = kind[data]
    before = np.empty_like(inside)
    before[1:], before[0] = inside[:-1], False
    before[bounds[bounds < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1], after[-1] = inside[1:], False
    cut = bounds[bounds > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def sequence_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive entries; order counts.  Empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U)
    m = len(h) - n + 1
    out = np.full(m, U((0xD6E8FEB86659FD93 * (2 * seed + 1)) % (1 << 64)))
    for i in range(n):
        out = mix(out * U(0x9FB21C651E98DF25) ^ h[i : i + m])
    return out


def no_straddle(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """True for each word position from which n words of one text follow, itself included."""
    ok = np.zeros(total, bool)
    if total:
        left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
        ok = left >= n
    return ok


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n entries.

    Runs of 1, 2, 4, ... entries are combined as the binary digits of n ask, so the
    cost grows with the logarithm of n.
    """
    m = max(0, len(h) - n + 1)
    out, at, power, size = np.full(m, U(n)), 0, h, 1
    while size <= n:
        if n & size:
            out = mix(out * U(0x9FB21C651E98DF25) ^ power[at : at + m])
            at += size
        if 2 * size <= n:
            power = mix(power[:-size] * U(0xD6E8FEB86659FD93) ^ power[size:]) if len(power) > size else power[:0]
        size *= 2
    return out


def minimizers(k: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` entries the index of its least one, the first of equals."""
    m = max(0, len(k) - width + 1)
    best, at = k[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, width):
        less = k[j : j + m] < best
        best[less], at[less] = k[j : j + m][less], j
    return at + np.arange(m)


def joined(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: one buffer, and each text's start and end in it."""
    size = (w.ends - w.starts)[keep]
    place = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place, size) + inner] = w.data[np.repeat(w.starts[keep], size) + inner]
    first = np.concatenate([[0], np.cumsum(keep)])[w.first]
    edge = np.concatenate([place, [len(out)]])[first]
    return out.tobytes(), edge[:-1], np.maximum(edge[1:] - 1, edge[:-1])
