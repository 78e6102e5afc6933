"""Words of whole texts as numpy arrays: where they start and end, and their 64-bit hashes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is looked at alone.
BLOCK = 4 << 20
_PLACES = np.random.default_rng(20_240_229).integers(1 << 63, size=4096, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _space(data: np.ndarray) -> np.ndarray:
    """Which bytes are 0x20 or 0x09 to 0x0D."""
    return (data == 0x20) | (data - np.uint8(0x09) < 5)


class Places:
    """Numbers distinct hashes in the order they are added in. An open table of cells: a hash's cell is its first bits', or the next that is free."""

    def __init__(self, h: np.ndarray | None = None):
        self.keys = np.empty(0, np.uint64)
        self._cells(1 << 16)
        if h is not None:
            self.add(h)

    def _cells(self, n: int) -> None:
        self.cells, self.shift = np.full(n, -1, np.int32), np.uint64(65 - n.bit_length())

    def _put(self, first: int) -> None:
        left = np.arange(first, len(self.keys), dtype=np.int32)
        cell = (self.keys[first:] >> self.shift).astype(np.int64)
        while len(left):
            free = self.cells[cell] < 0
            self.cells[cell[free]] = left[free]
            lost = self.cells[cell] != left
            left, cell = left[lost], cell[lost] + 1 & len(self.cells) - 1

    def add(self, h: np.ndarray) -> None:
        """Hashes that are distinct and not yet known."""
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, h])
        if 3 * len(self.keys) > len(self.cells):
            self._cells(1 << (4 * len(self.keys)).bit_length())
            first = 0
        self._put(first)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it isn't known."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        cell = (h >> self.shift).astype(np.int64)
        out = self.cells.take(cell)
        other = np.flatnonzero((self.keys[out] != h) & (out >= 0))
        cell = cell[other]
        while len(other):
            cell = cell + 1 & len(self.cells) - 1
            out[other] = at = self.cells.take(cell)
            lost = (self.keys[at] != h[other]) & (at >= 0)
            other, cell = other[lost], cell[lost]
        return out


@dataclass
class Words:
    """Words of a block of texts. data: its bytes, A-Z lower-cased. starts, ends: of words in data. first: for each text the number of its first word, and one more at the end."""

    raw: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        lengths, at, end = self.ends - self.starts, self.starts - self.starts[0], int(self.ends[-1])
        data = self.data[self.starts[0] : end]
        place = np.arange(len(data), dtype=np.int64)
        place -= np.repeat(at, np.diff(self.starts, append=end))
        inside = ~_space(data)
        long = place.max() > 4095  # white space counts on from the word before it
        h = _PLACES.take(place & 4095 if long else place)
        h *= (data.astype(np.uint16) + np.uint16(1)) * inside
        if long and lengths.max() > 4096:
            h += (place >> 12).astype(np.uint64) * _STEP * (data * inside)
        return mix(np.add.reduceat(h, at) + lengths.astype(np.uint64) * _STEP)

    def spelled(self, which: np.ndarray) -> list[str]:
        """The words with these numbers, gathered and decoded at once."""
        if not len(which):
            return []
        starts, n = self.starts[which], self.ends[which] - self.starts[which] + 1
        stop = np.cumsum(n)
        own = self.data.take(np.arange(stop[-1]) + np.repeat(starts - stop + n, n), mode="clip")
        own[stop - 1] = 0x0A
        return own[:-1].tobytes().decode("utf-8", "replace").split("\n")

    def text(self, i: int) -> list[bytes]:
        """The words of text i."""
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[self.first[i] : self.first[i + 1]], self.ends[self.first[i] : self.first[i + 1]], strict=True)]


def split(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of texts that lie one after another in data, between bounds."""
    word = ~_space(data)
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, word[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, word[1:]
    last = bounds[1:] - 1
    after[last[(last >= 0) & (bounds[1:] > bounds[:-1])]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, data + ((data - np.uint8(0x41) < 26) * np.uint8(0x20)), starts, ends, np.searchsorted(starts, bounds))


def blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """Texts of an Arrow string array in blocks of about so many bytes: first text, one past the last, and their words. Null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        yield at, to, split(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, sorted within the text, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    counts = np.diff(first)
    sets = []
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s = mix(s * _STEP + h[j : len(h) - k + 1 + j])
    for i in range(len(counts)):
        n = counts[i]
        if n >= k:
            sets.append(np.unique(s[first[i] : first[i + 1] - k + 1]))
        elif n:
            own = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[first[i] : first[i + 1]]:
                    own = mix(np.array([own * _STEP + x]))[0]
                sets.append(np.array([own ^ np.uint64(n)]))
        else:
            sets.append(np.empty(0, np.uint64))
    at = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=at[1:])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), at
