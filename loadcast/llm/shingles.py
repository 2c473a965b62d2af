"""Hashed words and shingles of Arrow batches: words split and hashed as bytes, windows of them in numpy."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 1 << 20
_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(rb"[\x20\x09-\x0D]")
SEED = 20240229
KNOWN_WORDS = 1 << 17
KNOWN_POWERS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word, SEED)
        return found


def _pieces(data: bytes) -> Iterator[bytes]:
    """Stretches of about ``PIECE_BYTES`` that end where a word ends."""
    at = 0
    while at < len(data):
        border = BLANK.search(data, at + PIECE_BYTES)
        end = border.start() if border else len(data)
        yield data[at:end]
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) and the words' offsets per text (length + 1).

    The hash is no polynomial of the bytes, which different words could share by their make.
    """
    known, hashes, offsets = _Words(), [np.zeros(0, np.uint64)], [0]
    for text in texts.cast(pa.large_binary()).to_pylist():
        n = 0
        for piece in _pieces(text or b""):
            words = piece.translate(LOWER).split()  # the blanks of bytes are those of BLANK
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            n += len(words)
        offsets.append(offsets[-1] + n)
        if len(known) > KNOWN_WORDS:
            known.clear()
    return np.concatenate(hashes), np.array(offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, exponents 0 to n."""
    if n > KNOWN_POWERS:
        return _powers(n)
    up, down = _known_powers()
    return up[: n + 1], down[: n + 1]


@cache
def _known_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KNOWN_POWERS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, BASE, np.uint64)
    down = np.full(n + 1, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its windows of ``width`` words; fewer words make one window."""
    hashes, offsets = word_hashes(texts)
    windows = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        windows += hashes[k : k + len(windows)] * FACTORS[k]
    windows = mixed(windows)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if high - low >= width:
            yield np.unique(windows[low : high - width + 1])
        elif high > low:
            short = (hashes[low:high] * FACTORS[: high - low]).sum(dtype=np.uint64) + FACTORS[-(high - low)]
            yield mixed(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
