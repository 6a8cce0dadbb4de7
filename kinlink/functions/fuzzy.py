"""Edit-based string similarity as Arrow functions.

The indel ratio is 2 * LCS / (lengths); the longest common subsequence is counted with the bit-parallel method of
Hyyro (2004): for many pairs at once on arrays of 64-bit words, and on Python's big integers where both strings are longer. Scores
are between 0 and 1. Two empty strings have ratio and partial ratio 1, a weighted ratio of 0, and Jaro-Winkler 1.

The functions of one pair say what the scores are; those with many in their names give the same for lists of pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & masks.get(c, 0)
        free = (free + hit | free - hit) & full
    return (free ^ full).bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length, or shorter at the ends, of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    n, letters, best = len(a), set(a), 0.0
    for end in range(1, len(b) + n):
        start = max(0, end - n)
        window = b[start:end]
        if window[-1] in letters or start and window[0] in letters:
            best = max(best, ratio(a, window))
    return best


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_words(a), _sorted_words(b))


def _word_sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    """The best of the common words against either side, and of both sides with the common words in front."""
    if not a.split() or not b.split():
        return 0.0
    both, only_a, only_b = _word_sets(a, b)
    if both and (not only_a or not only_b):
        return 1.0
    left, right = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    scores = [ratio(left, right)]
    if both:
        scores += [ratio(both, left), ratio(both, right)]
    return max(scores)


def partial_token_ratio(a: str, b: str) -> float:
    both, only_a, only_b = _word_sets(a, b)
    if both:
        return 1.0
    return max(partial_ratio(_sorted_words(a), _sorted_words(b)), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """Full ratios for strings of like length; scaled partial ones where one is much longer."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if longer < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


WORD = 63  # longest string whose places fit one machine word
CHUNK = 1 << 12
LETTERS = 400  # most different letters of a chunk; with more it is halved


def _codes(strings: list[str], width: int, alphabet: np.ndarray) -> np.ndarray:
    """A row of letter numbers for each string, ended by the number after the last."""
    width = max(width, 1)
    points = np.array(strings, dtype=f"U{width}").view(np.uint32).reshape(len(strings), width)
    lengths = np.array([len(s) for s in strings])
    number = np.zeros(int(alphabet[-1]) + 1, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    return np.where(np.arange(width) < lengths[:, None], number[points], len(alphabet))


def _masks(codes: np.ndarray, n_letters: int) -> np.ndarray:
    """For each string and letter the places where it stands, as bits."""
    masks, rows = np.zeros((len(codes), n_letters + 1), np.uint64), np.arange(len(codes))
    for k in range(codes.shape[1]):
        masks[rows, codes[:, k]] |= np.uint64(1 << k)
    masks[:, n_letters] = 0
    return masks


def _count(masks: np.ndarray, rows: np.ndarray, letters: Callable[[int], np.ndarray], steps: int, lengths: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the strings of masks[rows] (of such lengths) with others, of which
    letters(j) has the j-th letter of each.
    """
    flat, base = masks.ravel(), rows * masks.shape[1]
    full = (np.uint64(1) << lengths.astype(np.uint64)) - np.uint64(1)
    free = full.copy()
    for j in range(steps):
        hit = flat.take(base + letters(j))
        hit &= free
        rest = free - hit
        free += hit
        free |= rest
        free &= full
    return np.bitwise_count(free ^ full).astype(np.int64)


def _in_chunks(f: Callable, a: list[str], b: list[str], out: np.ndarray, at: np.ndarray) -> None:
    """f(a, b, alphabet) of the pairs at the given places, into out. Strings of a are at most WORD long, and none is empty."""
    for lo in range(0, len(at), CHUNK):
        todo = [at[lo : lo + CHUNK]]
        while todo:
            part = todo.pop()
            x, y = [a[k] for k in part], [b[k] for k in part]
            alphabet = np.unique(np.fromiter(map(ord, set().union(*map(set, chain(x, y)))), np.uint32))
            if len(alphabet) > LETTERS and len(part) > 1:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]
            else:
                out[part] = f(x, y, alphabet)


def _by_length(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """The shorter and the longer string of each pair."""
    return [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)], [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    a, b = _by_length(a, b)
    sizes = np.array([len(x) for x in a])
    out = np.zeros(len(a), np.int64)
    for k in np.flatnonzero(sizes > WORD):
        out[k] = lcs_length(a[k], b[k])

    def count(x: list[str], y: list[str], alphabet: np.ndarray) -> np.ndarray:
        lengths = np.array([len(s) for s in x])
        masks = _masks(_codes(x, int(lengths.max()), alphabet), len(alphabet))
        others = np.ascontiguousarray(_codes(y, max(map(len, y)), alphabet).T)
        return _count(masks, np.arange(len(x)), lambda j: others[j], len(others), lengths)

    # Pairs of like length stand together, so that a long string does not cost the others steps.
    small = np.flatnonzero((sizes > 0) & (sizes <= WORD))
    _in_chunks(count, a, b, out, small[np.argsort([len(b[k]) for k in small], kind="stable")])
    return out


def ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return np.where(total > 0, 2 * lcs_many(a, b) / np.maximum(total, 1), 1.0)


def partial_ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    a, b = _by_length(a, b)
    out = np.array([float(not y) if not x else float(x in y) for x, y in zip(a, b, strict=True)])
    open_ = [k for k, (x, v) in enumerate(zip(a, out, strict=True)) if x and v < 1]
    for k in open_:
        if len(a[k]) > WORD:
            out[k] = partial_ratio(a[k], b[k])

    def best(x: list[str], y: list[str], alphabet: np.ndarray) -> np.ndarray:
        n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        width = int(n.max())
        masks = _masks(_codes(x, width, alphabet), len(alphabet))
        # Every window of the longer strings: its pair, its beginning and its end.
        counts = m + n - 1
        rows = np.repeat(np.arange(len(x)), counts)
        end = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        start, end = np.maximum(0, end - n[rows]), np.minimum(end, m[rows])
        padded = np.pad(_codes(y, int(m.max()), alphabet), ((0, 0), (0, width)), constant_values=len(alphabet))
        across, flat, letters_of = padded.shape[1], padded.ravel(), masks.ravel()
        mask_at = lambda at: letters_of.take(rows * masks.shape[1] + flat.take(rows * across + at))
        # A window that neither begins nor ends with a letter of the shorter string is no better than a shorter one.
        useful = (mask_at(end - 1) > 0) | (start > 0) & (mask_at(start) > 0)
        rows, start, end = rows[useful], start[useful], end[useful]
        found = np.zeros(len(x))
        for lo in range(0, len(rows), CHUNK):
            r, s, e = (v[lo : lo + CHUNK] for v in (rows, start, end))
            base, size = r * across + s, e - s
            letters = lambda j, base=base, size=size: np.where(j < size, flat.take(base + j), len(alphabet))
            np.maximum.at(found, r, 2 * _count(masks, r, letters, int(size.max()), n[r]) / (n[r] + size))
        return found

    small = np.array([k for k in open_ if len(a[k]) <= WORD], dtype=np.int64)
    _in_chunks(best, a, b, out, small[np.argsort([len(a[k]) for k in small], kind="stable")])
    return out


def token_sort_ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    return ratio_many([_sorted_words(x) for x in a], [_sorted_words(y) for y in b])


def _token_set_many(sets: list[tuple[str, str, str]], filled: np.ndarray) -> np.ndarray:
    left = [f"{both} {x}".strip() for both, x, _ in sets]
    right = [f"{both} {y}".strip() for both, _, y in sets]
    common = [both for both, _, _ in sets]
    # What the common words are of a side that begins with them is a matter of lengths.
    some, sizes = np.array([bool(c) for c in common]), np.array([len(c) for c in common])
    own = [np.array([len(v) for v in side]) for side in (left, right)]
    parts = [np.where(some, 2 * sizes / np.maximum(sizes + n, 1), 0.0) for n in own]
    whole = some & np.array([not x or not y for _, x, y in sets])
    return np.where(filled, np.where(whole, 1.0, np.maximum(ratio_many(left, right), np.maximum(*parts))), 0.0)


def weighted_ratio_many(a: list[str], b: list[str], token_sort: np.ndarray | None = None, partial: np.ndarray | None = None) -> np.ndarray:
    """token_sort and partial: these ratios, where they are known already."""
    n, m = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    out = np.zeros(len(a))
    some = np.flatnonzero((n > 0) & (m > 0))
    if not len(some):
        return out
    a, b = [a[k] for k in some], [b[k] for k in some]
    longer = np.maximum(n, m)[some] / np.minimum(n, m)[some]
    whole, sets = ratio_many(a, b), [_word_sets(x, y) for x, y in zip(a, b, strict=True)]
    sort = token_sort_ratio_many(a, b) if token_sort is None else token_sort[some]
    filled = np.array([bool(x.split()) and bool(y.split()) for x, y in zip(a, b, strict=True)])
    made = np.maximum(whole, 0.95 * np.maximum(sort, _token_set_many(sets, filled)))
    far = np.flatnonzero(longer >= 1.5)
    if len(far):
        x, y, s = [a[k] for k in far], [b[k] for k in far], [sets[k] for k in far]
        scale = np.where(longer[far] <= 8, 0.9, 0.6)
        part = partial_ratio_many(x, y) if partial is None else partial[some[far]]
        tokens = np.maximum(partial_ratio_many([_sorted_words(v) for v in x], [_sorted_words(v) for v in y]), partial_ratio_many([v for _, v, _ in s], [v for _, _, v in s]))
        tokens = np.where([bool(both) for both, _, _ in s], 1.0, tokens)
        made[far] = np.maximum(whole[far], np.maximum(scale * part, 0.95 * scale * tokens))
    out[some] = made
    return out


def _distinct(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray]:
    """The distinct pairs, and the place of each row's pair among them."""
    known: dict[tuple[str, str], int] = {}
    at = np.array([known.setdefault(pair, len(known)) for pair in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=np.int64)
    return [x for x, _ in known], [y for _, y in known], at


def _pairwise(f: Callable[[list[str], list[str]], np.ndarray]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y, at = _distinct(a, b)
        return pd.Series(np.asarray(f(x, y), dtype="float64")[at] if x else [], dtype="float64")

    return run


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


ratio_column = _pairwise(ratio_many)
partial_ratio_column = _pairwise(partial_ratio_many)
token_sort_ratio_column = _pairwise(token_sort_ratio_many)
weighted_ratio_column = _pairwise(weighted_ratio_many)
jaro_winkler_column = _pairwise(jaro_winkler_many)


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in ("token_sort", "partial", "weighted")]))
def ratios_column(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The three ratios in one pass, sharing what they have in common."""
    x, y, at = _distinct(a, b)
    if not x:
        return pd.DataFrame({"token_sort": [], "partial": [], "weighted": []}, dtype="float64")
    sort, partial = token_sort_ratio_many(x, y), partial_ratio_many(x, y)
    return pd.DataFrame({"token_sort": sort[at], "partial": partial[at], "weighted": weighted_ratio_many(x, y, sort, partial)[at]})
