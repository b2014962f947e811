"""Words of texts as bytes, hashed many at a time: runs of bytes other than space and
0x09 to 0x0D."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
_LONG_WORD = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: The first so many bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hash_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of ``data``, which has eight bytes more behind: eight bytes at a
    time are mixed in, and no step is linear in them."""
    at = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    sizes = ends - starts
    h = mix((at[starts] & _FIRST[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * BASE))
    rows = np.flatnonzero(sizes > 8)
    for done in range(8, _LONG_WORD, 8):
        if not len(rows):
            break
        chunk = at[starts[rows] + done] & _FIRST[np.minimum(sizes[rows] - done, 8)]
        h[rows] = mix(h[rows] * BASE + mix(chunk + np.uint64(done)))
        rows = rows[sizes[rows] > done + 8]
    for k in np.flatnonzero(sizes > _LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return h


def words_of(texts: list) -> tuple:
    """(data, starts, ends, first): the texts put together, its words' places, and the
    number of the first word of every text, with the number of all at the end."""
    data = b"\n".join(texts) + b" " * 9
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    flips = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = flips[::2], flips[1::2]
    return data, starts, ends, np.searchsorted(starts, edge, side="left")
