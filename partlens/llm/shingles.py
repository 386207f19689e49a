"""Word shingles of texts as sorted sets of 64-bit hashes, vectorised over bytes.

Words are those of `common.WORD`, A-Z lower-cased; a shingle is `size` consecutive words, or all words of a
shorter text. A text without words has no shingles.
"""

from __future__ import annotations

import numpy as np

_RADIX = 0x9E3779B97F4A7C15
#: Texts are worked on in slices of about so many bytes, cut between words.
_SLICE = 1 << 20


def _byte_table() -> np.ndarray:
    table = np.zeros(256, np.uint64)
    for byte in range(256):
        if byte >= 0x80 or chr(byte).isalnum():
            table[byte] = ord(chr(byte).lower()) if byte < 0x80 else byte
    return table


_BYTES = _byte_table()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_RADIX, -1, 1 << 64)
        both = []
        for base in (_RADIX, inverse):
            grown = np.ones(1, np.uint64)
            while len(grown) < size:
                grown = np.concatenate([grown, grown * np.uint64(pow(base, len(grown), 1 << 64))])
            both.append(grown)
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_slice(raw: bytes) -> np.ndarray:
    codes = _BYTES[np.frombuffer(raw, np.uint8)]
    on = codes != 0
    starts = np.flatnonzero(on & ~np.concatenate([[False], on[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(codes))
    return mixed(np.add.reduceat(codes * power[: len(codes)], starts) * inverse[starts])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts, at = [], 0
    while len(raw) - at > _SLICE:
        cut = at + _SLICE
        while cut < len(raw) and _BYTES[raw[cut]]:
            cut += 1
        parts.append(_hash_slice(raw[at:cut]))
        at = cut
    parts.append(_hash_slice(raw[at:]))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for j in range(width):
        total += hashes[j : len(hashes) - width + 1 + j] * np.uint64(2 * pow(31, j + 7) + 1)
    return np.unique(mixed(total))
