"""Words of many texts at once: 64-bit hashes by array operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_M = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(4096, np.uint64)
for _k in range(1, 4096):
    _POWERS[_k] = np.uint64(int(_POWERS[_k - 1]) * _M & (1 << 64) - 1)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Classes for ``split_punctuation``: 0 space, 1 letters, digits and all bytes of other scripts, 2 the rest.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[0x80:] = 1
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _CLASS[_lo:_hi] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[str], split_punctuation: bool = False, heads: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, number of words up to and with each text), with ``heads`` also the first byte of each word.

    A-Z count as a-z.  Words are runs of bytes other than ASCII white space; with
    ``split_punctuation`` also changes between punctuation and other characters part words.
    Two words get the same hash only if a random linear form of their bytes agrees modulo 2**64.
    """
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    if split_punctuation:
        kind = _CLASS[raw]
        start = np.empty(len(raw), bool)
        start[0] = kind[0] > 0
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start &= kind > 0
    else:
        space = _SPACE[raw]
        start = ~space
        start[1:] &= space[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return (np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), np.zeros(0, np.uint8))[: 2 + heads]
    word = np.cumsum(start, dtype=np.int32) - 1
    place = np.arange(len(raw), dtype=np.int32) - at.astype(np.int32)[np.maximum(word, 0)]
    value = _BYTE[_LOWER[raw]] * _POWERS[place & 4095]
    far = np.flatnonzero(place > 4095)
    if len(far):  # a word's hash must not depend on the words around it
        value[far] *= _mix((place[far] >> 12).astype(np.uint64)) | np.uint64(1)
    value[(_CLASS[raw] == 0)] = 0
    hashes = _mix(np.add.reduceat(value, at))
    return (hashes, np.searchsorted(at, ends), raw[at])[: 2 + heads]


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text one text after the other, sorted in each; bounds).

    A text with fewer words than ``width`` has its whole sequence as its one shingle; one
    without words has none.
    """
    words, upto = word_hashes(texts)
    first = np.concatenate([[0], upto[:-1]])
    count = upto - first
    n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    begin = np.concatenate([[0], np.cumsum(n)])
    pos = first[owner] + np.arange(begin[-1]) - begin[owner]
    out = np.zeros(len(pos), np.uint64)
    last = upto[owner]
    for k in range(width):
        there = pos + k < last
        out = np.where(there, _mix(out * np.uint64(_M) + words[np.minimum(pos + k, len(words) - 1)] + np.uint64(k)), out) if len(words) else out
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each word with its successor."""
    return _mix(words[:-1] * np.uint64(_M) + words[1:])
