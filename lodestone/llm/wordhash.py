"""Words of UTF-8 texts and hashes of word runs, a batch of documents at a time."""

from __future__ import annotations

import zlib

import numpy as np

LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; anything else is a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_STEP, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space, tab and \\n \\v \\f \\r."""
    return text.translate(LOWERED).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, a-z and non-ASCII characters."""
    return text.translate(ALNUM).split() if text else []


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the SplitMix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def run_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` successive words; none if there are fewer words."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for at in range(length):
        h = h * _STEP + codes[at : at + n]
    return mixed(h)
