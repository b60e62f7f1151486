"""Words, hashes and shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation and controls.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed invertible mixer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 2 * len(_powers), 1024), np.uint64(0xD1342543DE82EF95))
            steps[0] = 1
            _powers = np.cumprod(steps)
    return _powers[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one array, and where each text starts (one more entry ends it)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of some texts: ``starts`` and ``ends`` in the bytes, ``doc`` of each, ``first`` word of each text.

    Words end at white space, or at ASCII punctuation too; ``lower`` lower-cases A to Z.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, punctuation: bool = False):
        data, self.offsets = utf8(texts)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~(PUNCTUATION if punctuation else SPACE)[data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        here = inside[1:-1]
        self.starts = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.empty(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(at)) - at
        letters = self.data[np.repeat(self.starts, lengths) + place]
        with np.errstate(over="ignore"):
            parts = BYTE[letters] * powers(int(lengths.max()))[place]
            return mix(np.add.reduceat(parts, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` words in each text, sorted within the text, and where each text starts.

    A text with fewer words (but one at least) has its whole sequence as its only shingle.
    """
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            runs = runs * np.uint64(0xD1342543DE82EF95) + words[k : k + len(runs)] + np.uint64(k)
        runs = mix(runs)
    out, bounds = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts):
        a = first[i]
        if n >= size:
            found = np.unique(runs[a : a + n - size + 1])
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[a : a + n]:
                    h = h * np.uint64(0xD1342543DE82EF95) + w
            found = mix(np.array([h], np.uint64) ^ ODD)
        else:
            found = np.empty(0, np.uint64)
        out.append(found)
        bounds[i + 1] = bounds[i] + len(found)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), bounds
