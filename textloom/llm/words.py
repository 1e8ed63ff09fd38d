"""Words of a block of UTF-8 texts, found, coded and numbered with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes between words: blanks, and tab to carriage return.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: A to Z as a to z, all other bytes as they are.
LOWER = np.array([c | 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_BELOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers in which every bit depends on every other; not linear in any arithmetic."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def spans(raw: np.ndarray, off: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, bytes, document) of the words of a block; off holds where documents start and the block ends."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~blank[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    last = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:]))
    return first, last - first + 1, np.searchsorted(off, first, "right") - 1


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def codes(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Words that differ within one aligned run of eight bytes only never share one."""
    eight, out = _eights(raw), mix((length.astype(np.uint64) + np.uint64(1)) * _ODD)
    live, k = np.flatnonzero(length <= LONG_WORD), 0
    while len(live):
        rest = length[live] - 8 * k
        out[live] = mix(out[live] ^ (eight[first[live] + 8 * k] & _BELOW[np.minimum(rest, 8)]))
        live, k = live[rest > 8], k + 1
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : first[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def distinct(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct word, which of them each word is): codes sort the words, their bytes decide."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, at, own = np.unique(codes(raw, first, length), return_index=True, return_inverse=True)
    head, eight = at[own], _eights(raw)
    same = bool((length == length[head]).all())
    live, k = np.flatnonzero(head != np.arange(len(first))), 0
    while same and len(live):
        rest = length[live] - 8 * k
        same = bool((((eight[first[live] + 8 * k] ^ eight[first[head[live]] + 8 * k]) & _BELOW[np.minimum(rest, 8)]) == 0).all())
        live, k = live[rest > 8], k + 1
    if same:
        return at, own
    seen: dict[bytes, int] = {}
    own = np.array([seen.setdefault(raw[i : i + n].tobytes(), len(seen)) for i, n in zip(first, length, strict=True)], np.int64)
    return np.unique(own, return_index=True)[1], own


def numbers(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same number for equal words, another one for others."""
    return distinct(raw, first, length)[1]
