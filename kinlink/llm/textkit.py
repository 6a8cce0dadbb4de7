"""Vectorised word and shingle hashing of Arrow string batches.

Words are runs of bytes outside a separator table; all hashing is 64-bit arithmetic on numpy
arrays, so no Python object is made per word. Equal words give equal hashes in every batch.
"""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of plain words: ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of bare words: all of ASCII but letters and digits.
PUNCT = np.zeros(256, dtype=bool)
PUNCT[:128] = True
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n + 1, PIECE + 4096)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _hash_piece(raw: np.ndarray, separators: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, hash) of each word of a piece; doc_starts: positions where words end in any case."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~separators[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if len(doc_starts):
        first[doc_starts] = inside[doc_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        terms = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(terms, out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        return starts, mix(value + ODD * (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, A-Z taken as a-z.

    data: the bytes; offsets: where each text starts, and the end. Returns the hashes in order and,
    for each text and the end, the index of its first word.
    """
    found_at, found = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + PIECE, end)
        while stop < end and not separators[data[stop]]:  # a piece ends between words
            step = separators[data[stop : stop + PIECE]]
            stop += int(step.argmax()) if step.any() else len(step)
        lo, hi = np.searchsorted(offsets, [at, stop])
        starts, hashes = _hash_piece(data[at:stop], separators, np.unique(offsets[lo:hi] - at))
        found_at.append(starts + at)
        found.append(hashes)
        at = stop
    where = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(where, offsets)


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string array; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, where


def slices_of(n_bytes: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each, so that temporary arrays stay small."""
    cuts, total, begun = [], 0, 0
    for i, n in enumerate(n_bytes):
        if total and total + n > most:
            cuts.append((begun, i))
            begun, total = i, 0
        total += int(n)
    if begun < len(n_bytes):
        cuts.append((begun, len(n_bytes)))
    return cuts


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of `width` words; the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    w = min(n, width)
    with np.errstate(over="ignore"):
        total = np.full(n - w + 1, np.uint64(w), dtype=np.uint64)
        for k in range(w):
            total = total * ODD + words[k : n - w + 1 + k]
            total ^= total >> np.uint64(29)
    return np.unique(mix(total))


def string_keys(columns: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """64-bit keys of strings of equal length, given by arrays of their first, second, ... characters."""
    h = np.full(len(columns[0]), np.uint64(salt + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = h * ODD + c.astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
    return mix(h + np.uint64(len(columns)))
