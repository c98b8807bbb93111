"""Words of many texts at once, as arrays.

A word is a longest run of characters other than space and ``\\x09-\\x0D``.
All texts of an Arrow batch are cut in one pass over their UTF-8 bytes, so
the work per word is a few array operations. Equal words get equal 64-bit
hashes; hashes are a fixed function of the bytes, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Text bytes that are worked on at a time; a longer single text is one chunk.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed alone."""
    steps = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return mix(steps + _U(seed)) | _U(1)


_places = constants(1024, 11)


def _place_constants(n: int) -> np.ndarray:
    global _places
    if n > len(_places):
        _places = constants(2 * n, 11)
    return _places


@dataclass
class Words:
    """The words of the texts first..first+len(counts)-1 of a batch.

    data: the UTF-8 bytes of these texts, one after another; text_starts,
    text_ends: where each text begins and ends in data. starts, ends: byte positions of each word in data.
    counts: words of each text; offsets: its running total, from 0.
    """

    first: int
    data: np.ndarray
    text_starts: np.ndarray
    text_ends: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))

    def take(self, texts: np.ndarray) -> Words:
        """The words of some of the texts, by ascending place."""
        chosen = np.zeros(len(self.counts), dtype=bool)
        chosen[texts] = True
        own = np.repeat(chosen, self.counts)
        return Words(
            self.first, self.data, self.text_starts[texts], self.text_ends[texts], self.starts[own], self.ends[own], self.counts[texts]
        )

    def bytes_in(self, table: np.ndarray, words: bool = False) -> np.ndarray:
        """How many bytes of each text (or word) the table of 256 marks."""
        running = np.concatenate(([0], np.cumsum(table[self.data])))
        return running[self.ends] - running[self.starts] if words else running[self.text_ends] - running[self.text_starts]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z."""
        out = [np.zeros(0, dtype=_U)]
        low = 0
        while low < len(self.starts):
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + CHUNK_BYTES)))
            out.append(self._hashes(low, high, lower))
            low = high
        return np.concatenate(out)

    def _hashes(self, low: int, high: int, lower: bool) -> np.ndarray:
        base = self.starts[low]
        starts = self.starts[low:high] - base
        lengths = self.ends[low:high] - base - starts
        shift = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(shift, lengths)
        data = self.data[base : self.ends[high - 1]][place + np.repeat(starts, lengths)]
        if lower:
            data = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        values = (data.astype(_U) + _U(1)) * _place_constants(int(lengths.max()))[place]
        return mix(np.add.reduceat(values, shift) + lengths.astype(_U))

    def code_points(self) -> np.ndarray:
        """Code points in the words of each text."""
        first_bytes = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        per_word = first_bytes[self.ends] - first_bytes[self.starts]
        running = np.concatenate(([0], np.cumsum(per_word)))
        return np.diff(running[self.offsets])


def grams(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of every n consecutive values; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(size, dtype=_U)
    for k, c in enumerate(constants(n, seed)):
        out += hashes[k : k + size] * c
    return mix(out)


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and the n + 1 places where they begin and end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(places: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least."""
    low, n = 0, len(places) - 1
    while low < n:
        high = int(np.searchsorted(places, places[low] + size, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def split(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of the texts, in chunks of about ``size`` bytes; a null text has none."""
    data, places = utf8(texts)
    for low, high in chunks(places, size):
        part = data[places[low] : places[high]]
        ends = places[low : high + 1] - places[low]
        inside = ~_SPACE[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        heads = ends[:-1][ends[:-1] < len(part)]
        starts[heads] = inside[heads]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        tails = ends[1:][ends[1:] > 0] - 1
        stops[tails] = inside[tails]
        begun = np.flatnonzero(starts)
        counts = np.diff(np.searchsorted(begun, ends))
        yield Words(low, part, ends[:-1], ends[1:], begun, np.flatnonzero(stops) + 1, counts)
