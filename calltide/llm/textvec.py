"""Whole-batch text handling in numpy, shared by the operators that run on Arrow batches.

Texts are laid end to end in one array of code points (or UTF-8 bytes) and every step is an array operation over the
batch, so a batch costs a few nanoseconds per character and no Python object per word. ``slices`` bounds the characters
that are held at once; one document longer than the bound forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
SLICE_CHARS = 1 << 18


def slices(lengths: np.ndarray, bound: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive documents with at most ``bound`` characters each, or a single longer document."""
    ends = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + bound, side="right")))
        yield i, j
        i = j


def text_column(batch, name: str) -> list[str]:
    """A string column of an Arrow batch with nulls as empty strings."""
    return [x or "" for x in batch.column(name).to_pylist()]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one uint32 array, and n+1 offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one uint8 array, and n+1 offsets."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) for t in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise over uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS = np.zeros(0, U64)


def _multipliers(n: int) -> np.ndarray:
    """Fixed pseudo-random odd multipliers for positions 0..n-1 within a word."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        made = mix((np.arange(1, size + 1, dtype=U64)) * U64(0x9E3779B97F4A7C15)) | U64(1)
        if size > 1 << 22:
            return made
        _POWERS = made
    return _POWERS[:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[starts[k]:ends[k]] for non-empty, increasing, disjoint spans."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = symbols[np.repeat(starts, lengths) + within].astype(U64) + U64(1)
    values *= _multipliers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes of a word, for words [0-9A-Za-z] and everything beyond ASCII, and ASCII lower case.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 32


def ascii_lower_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, index of the first word of each text and the total at the end).

    Words are maximal runs of WORD_BYTE within one text, after lower-casing A-Z only.
    """
    low = LOWER_BYTE[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = WORD_BYTE[raw]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    at = offsets[1:-1]
    at = at[(at > 0) & (at < len(raw))]
    begins[at] = inside[at + 1]
    finishes[at - 1] = inside[at]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)
