"""Hashes of the words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from lodegraph.llm.common import WORD_TABLE

_rng = np.random.default_rng(5)
#: A random odd number for each byte, and one for each place in a word; places beyond the table use powers of the last.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    if n <= len(_PLACE):
        return _PLACE
    more = [_PLACE]
    while sum(map(len, more)) < n:
        more.append(mix(more[-1]) | np.uint64(1))
    return np.concatenate(more)


def words_at(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes of all texts with a blank after each (words normalised), starts and ends of words, text of each word, text offsets."""
    joined = b" ".join(raws) + b" "
    flat = np.frombuffer(joined.translate(WORD_TABLE), dtype=np.uint8)
    inside = flat != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(flat) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    return flat, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, offsets


def hash_words(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), sizes)
    value = _BYTE[flat[np.repeat(starts.astype(np.int32), sizes) + place]]
    value *= _places(int(sizes.max()))[place]
    return mix(np.add.reduceat(mix(value), begin))


def chunks(raws: list[bytes], size: int = 1 << 20):
    """Slices of raws of about size bytes; a longer text stands alone."""
    first, held = 0, 0
    for i, r in enumerate(raws):
        if held and held + len(r) > size:
            yield slice(first, i)
            first, held = i, 0
        held += len(r) + 1
    if first < len(raws):
        yield slice(first, len(raws))


def shingles(raws: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle hashes in text order, the text of each, and words by text. A text of fewer than n words, but not none, has one shingle."""
    flat, starts, ends, text, _ = words_at(raws)
    h = hash_words(flat, starts, ends)
    count = np.bincount(text, minlength=len(raws)) if len(text) else np.zeros(len(raws), dtype=np.int64)
    total = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for j in range(n):
        total += h[j : j + len(total)] * _PLACE[j]
    whole = text[: len(total)] == text[n - 1 :] if len(total) else np.zeros(0, dtype=bool)
    s, t = mix(total[whole]), text[: len(total)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(text, short)
        extra = np.array([int(mix(np.add.reduce(h[f : f + c] * _PLACE[:c], keepdims=True) + np.uint64(c))[0]) for f, c in zip(first, count[short], strict=True)], dtype=np.uint64)
        s, t = np.concatenate([s, extra]), np.concatenate([t, short])
        by = np.argsort(t, kind="stable")
        s, t = s[by], t[by]
    return s, t, count


def multisets(s: np.ndarray, t: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of distinct shingles, by text and shingle. t ascends."""
    if not len(s):
        return t[:0], s, np.zeros(0, dtype=np.int64)
    s = s.copy()
    bounds = np.searchsorted(t, np.arange(n_texts + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            s[a:b].sort()
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])))
    at = np.flatnonzero(new)
    return t[at], s[at], np.diff(np.concatenate((at, [len(s)])))
