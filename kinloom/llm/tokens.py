"""Words of whole batches of texts as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over a random value per byte, taken as a difference
of running sums, and then mixed.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_R = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
for _b in range(65, 91):
    _BYTE[_b] = _BYTE[_b + 32]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes hashed at once.
PIECE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, n - 1).bit_length()
        for k, r in enumerate((_R, _R_INVERSE)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Of UTF-8 texts: the hash of every word (between bytes 0x20 and 0x09 to 0x0D, A-Z as a-z), where each text's words begin, and each word's first and last byte in the joined text."""
    joined = b"\n".join([b"", *texts, b""])
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8)))
    first, last = edge[::2] + 1, edge[1::2] + 1  # the joined text begins and ends with space
    hashes = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):  # pieces that end between words
        base = int(first[i])
        j = max(i + 1, int(np.searchsorted(last, base + PIECE, side="right")))
        end = int(last[j - 1])
        power, inverse = _power(end - base + 1)
        run = np.zeros(end - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:end]] * power[: end - base], out=run[1:])
        hashes[i:j] = (run[last[i:j] - base] - run[first[i:j] - base]) * inverse[first[i:j] - base]
        i = j
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.searchsorted(first, np.cumsum(np.append(0, sizes)) + 1 if len(texts) else np.zeros(1))
    return mix(hashes), starts, first, joined, last
