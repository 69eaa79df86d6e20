"""Window hashes of word sequences, computed with numpy over whole texts.

A word's hash mixes its bytes eight at a time; words of over 32 bytes have XXH3 instead. A window's hash is a
sum of its words' hashes times fixed odd numbers, mixed. The anchor of a window is the smallest hash of the short
word groups inside it: equal windows have equal anchors, and a text has far fewer anchors than windows.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_ODD = (np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.int64).view(np.uint64) << _U(1)) | _U(1)


#: Bytes of a word that are hashed eight at a time with numpy; longer words are few and have XXH3.
_SHORT = 32
#: The bytes of a little-endian load that belong to a word of so many bytes.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """One to one on 64 bits."""
    x = (x ^ (x >> _U(33))) * _ODD[60]
    x = (x ^ (x >> _U(29))) * _ODD[61]
    return x ^ (x >> _U(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of every word of a text, in order; words are what ``raw.split()`` gives."""
    x = np.frombuffer(raw + bytes(_SHORT + 1), np.uint8)  # so that loads end inside and a word ends before it
    body = (x != 32) & (x - np.uint8(9) > 4)
    body[len(raw) :] = False
    edges = np.flatnonzero(body[1:] != body[:-1]) + 1
    if body[0]:
        edges = np.concatenate(([0], edges))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    loads = np.ndarray(len(x) - 7, "<u8", x, strides=(1,))
    h = _mix((loads[starts] & _MASK[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _ODD[62])
    for at in range(8, _SHORT, 8):
        on = np.flatnonzero(lengths > at)
        if not len(on):
            break
        h[on] = _mix((loads[starts[on] + at] & _MASK[np.minimum(lengths[on] - at, 8)]) * _ODD[63] ^ h[on])
    for i in np.flatnonzero(lengths > _SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + lengths[i]])
    return h


def group_hashes(h: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = h[:n] * _ODD[salt]
    for i in range(1, size):
        x = x + h[i : i + n] * _ODD[(salt + i) % 64]
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values, by doubling."""
    span = 1
    while span < size:
        step = min(span, size - span)
        x = np.minimum(x[: len(x) - step], x[step:])
        span += step
    return x


def anchors(h: np.ndarray, window: int, group: int) -> np.ndarray:
    """The anchor of every window of a text, given its words' hashes."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(group_hashes(h, group, 0), window - group + 1)


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    return group_hashes(h, window, 32)


def other_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Second hashes of the windows, over other hashes of the words, so that no sum agrees in both by rule."""
    other = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return group_hashes(other ^ (other >> _U(29)), window, 17)
