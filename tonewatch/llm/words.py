"""Words of texts as 64-bit hashes, by vectorised steps over their bytes.

A word's hash is a polynomial of its bytes, cut out of running sums over the
whole text, so no word is looked at on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

from .common import hold

_REMEMBERED = 300_000
_LONGEST_REMEMBERED = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer word takes its own length.
_BYTES_AT_ONCE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """``base ** i`` for ``i`` below ``size``, kept for the longest text so far."""
    known = _powers.get(base)
    if known is None or len(known) < size:
        length = max(1 << (size - 1).bit_length(), 1 << 16) if size else 1 << 16
        known = np.full(length, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:size]


def _hashed(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in some bytes, and where each begins."""
    inside = np.zeros(len(part) + 2, np.int8)
    inside[1:-1] = ~_SPACE[part]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(part))[starts]), starts


def text_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, parted at ASCII white space; how many each text has."""
    whole = b"\n".join(texts).lower()
    place = np.frombuffer(whole, np.uint8)
    hashes, starts, low = [], [], 0
    while low < len(place):
        high = min(low + _BYTES_AT_ONCE, len(place))
        while high < len(place):  # back to white space, or on to it within a longer word
            spaces = np.flatnonzero(_SPACE[place[low:high]])
            if len(spaces):
                high = low + int(spaces[-1]) + 1
                break
            high = min(2 * high - low, len(place))
        own, at = _hashed(place[low:high])
        hashes.append(own)
        starts.append(at + low)
        low = high
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


class _Hashes(dict):
    """Hashes of words met lately; the table starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= _LONGEST_REMEMBERED:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """XXH64 of single words, whatever parted them; not the hashes of ``text_words``."""
    hold("words", _hashes.clear)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread combined hashes over all 64 bits; changes ``values``."""
    values ^= values >> np.uint64(29)
    values *= MULTIPLIER
    return values ^ (values >> np.uint64(32))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    number = max(len(words) - size + 1, 0)
    found = words[:number].copy()
    for i in range(1, size):
        found *= MULTIPLIER
        found += words[i : i + number]
    return mixed(found)
