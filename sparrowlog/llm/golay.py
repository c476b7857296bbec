"""Fuzzy hash keys from the perfect binary (23, 12) Golay code.

Every 23-bit word lies within three bits of exactly one codeword.  The keys of
a word are the indices of all codewords within four bits of it: the nearest
one and, if that is three bits off, five more; else none.  Two words that
differ in two bits or fewer always share a key: take the word halfway between
them and its nearest codeword, which is within four bits of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, INDEX_BITS = 23, 12


def _remainder(word: np.ndarray) -> np.ndarray:
    """Of the division by the generator: the syndrome."""
    r = word.astype(np.int64)
    for shift in range(LENGTH - 1, 10, -1):
        r = np.where((r >> shift) & 1, r ^ (GENERATOR << (shift - 11)), r)
    return r


#: Tables once they are made.
_made: dict[str, tuple] = {}


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern; whether it has three bits; the five codewords of weight 7 that hold those bits."""
    if "tables" in _made:
        return _made["tables"]
    errors = np.zeros(2048, np.int64)
    three = np.zeros(2048, bool)
    holding = np.zeros((2048, 5), np.int64)
    info = np.arange(4096, dtype=np.int64) << 11
    codewords = info | _remainder(info)
    light = codewords[np.bitwise_count(codewords) == 7]
    for weight in range(4):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        syndromes = _remainder(patterns)
        errors[syndromes] = patterns
        if weight == 3:
            three[syndromes] = True
            for p, s in zip(patterns, syndromes):
                holding[s] = light[(light & p) == p]
    return _made.setdefault("tables", (errors, three, holding))


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    return _made.get("syndromes") or _made.setdefault("syndromes", _both_halves())


def _both_halves() -> tuple[np.ndarray, np.ndarray]:
    return _remainder(np.arange(2048, dtype=np.int64) << 12), _remainder(np.arange(4096, dtype=np.int64))


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of up to 23 bits: an (n, 6) table of codeword indices, and which of its cells are keys."""
    errors, three, holding = tables()
    high, low = _syndromes()
    words = words.astype(np.int64)
    s = high[words >> 12] ^ low[words & 4095]
    nearest = words ^ errors[s]
    table = np.concatenate([nearest[:, None], nearest[:, None] ^ holding[s]], axis=1) >> 11
    valid = np.repeat(three[s][:, None], 6, axis=1)
    valid[:, 0] = True
    return table, valid


#: Widths of the three segments of a 64-bit fingerprint, highest bits first.
SEGMENTS = (22, 21, 21)


def segments(fingerprints: np.ndarray) -> list[np.ndarray]:
    out, left = [], 64
    for width in SEGMENTS:
        left -= width
        out.append(((fingerprints >> np.uint64(left)) & np.uint64((1 << width) - 1)).astype(np.int64))
    return out


def exact_and_fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs that any two fingerprints within two bits share.

    Two errors over three segments leave one segment without any: its bits
    as they are, with the Golay keys of the segment after it.
    """
    seg = segments(fingerprints)
    return _paired([(seg[i], *keys(seg[(i + 1) % 3])) for i in range(3)])


def _paired(parts: list) -> tuple[np.ndarray, np.ndarray]:
    rows, out = [], []
    for at, (exact, index, has) in enumerate(parts):
        for y in range(6):
            on = np.flatnonzero(has[:, y])
            rows.append(on)
            out.append((at << 40) | (exact[on] << INDEX_BITS) | index[on, y])
    return np.concatenate(rows), np.concatenate(out)
