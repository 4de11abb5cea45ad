"""Sets of hashed word shingles, made in numpy from a text's bytes.

Words are the runs of bytes other than the six ASCII blanks, with A-Z lower-cased.
A word's hash is the sum of random 64-bit numbers keyed by (place in the word, byte);
a shingle's hash mixes its words' hashes in order. Two texts' shingles are taken
as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_PLACES = 64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, size=(_PLACES, 256), dtype=_U)
_TABLE[:, 65:91] = _TABLE[:, 97:123]
_ODD = _rng.integers(0, 2**63, size=16, dtype=_U) * _U(2) + _U(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at a time.
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _block_hashes(raw: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of raw; with starts, where texts begin (its end last), also each text's number of words."""
    at = np.flatnonzero(~_BLANK[raw])
    if not len(at):
        return np.empty(0, dtype=_U) if starts is None else (np.empty(0, dtype=_U), np.zeros(len(starts) - 1, dtype=np.int64))
    new = np.diff(at, prepend=-2) > 1
    if starts is not None:
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[starts] = True
        new |= begins[at]
    first = np.flatnonzero(new)
    sizes = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    value = _TABLE[place & (_PLACES - 1), raw[at]]
    if sizes.max() > _PLACES:
        value = value * (_U(2) * (place // _PLACES).astype(_U) + _U(1))
    hashes = mix(np.add.reduceat(value, first) + sizes.astype(_U))
    return hashes if starts is None else (hashes, np.diff(np.searchsorted(at[first], starts)))


def word_hashes(body: bytes | memoryview) -> np.ndarray:
    """One 64-bit hash per word, in order."""
    raw = np.frombuffer(body, dtype=np.uint8)
    if len(raw) <= _BLOCK:
        return _block_hashes(raw)
    out, start = [], 0
    while start < len(raw):
        end = min(start + _BLOCK, len(raw))
        while end < len(raw) and not _BLANK[raw[end]]:
            ahead = np.flatnonzero(_BLANK[raw[end : end + _BLOCK]])
            end = end + int(ahead[0]) if len(ahead) else min(end + _BLOCK, len(raw))
        out.append(_block_hashes(raw[start:end]))
        start = end
    return np.concatenate(out)


def batch_words(bodies: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, words of each text) for runs of texts of about _BLOCK bytes; null: none."""
    lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in bodies]
    k = 0
    while k < len(lengths):
        stop, size = k + 1, lengths[k]
        while stop < len(lengths) and size + lengths[stop] <= _BLOCK:
            size += lengths[stop]
            stop += 1
        if stop == k + 1:
            hashes = word_hashes(bodies[k].as_buffer()) if lengths[k] else np.empty(0, dtype=_U)
            yield k, hashes, np.array([len(hashes)])
        else:
            raw = np.frombuffer(b"".join(x.as_buffer() for x in bodies[k:stop] if x.is_valid), dtype=np.uint8)
            yield k, *_block_hashes(raw, np.append(0, np.cumsum(lengths[k:stop])))
        k = stop


def shingle_set(body: bytes | memoryview, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer words than size make one shingle, none make none."""
    words = word_hashes(body)
    n = len(words)
    if n == 0:
        return words
    take = min(n, size)
    total = np.full(n - take + 1, _U(take), dtype=_U)
    for i in range(take):
        total += words[i : n - take + 1 + i] * _ODD[i]
    return np.unique(mix(total))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
