"""XXH3 (64 bits, no seed) of all words of an Arrow array at once."""

from __future__ import annotations

import numpy as np

#: The start of the algorithm's own secret, and its multipliers.
_SECRET = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e"), "<u8")
_BYTE, _SHORT, _LONG = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25), np.uint64(0x165667919E3779F9)
_LAST = np.uint64(0x165667B19E3779F9)
_LOW = np.uint64(0xFFFFFFFF)
#: Longest word that is hashed here; others go one by one.
MOST = 16
#: Words at once, whose arrays stay in a core's cache.
BLOCK = 1 << 13


def _u(n: int) -> np.uint64:
    return np.uint64(n)


def _eight(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on; wide are all bytes, eight at a time, with two more at the end."""
    word, shift = at >> 3, (at & 7).astype(np.uint64) << _u(3)
    low = wide.take(word) >> shift
    word += 1
    high = wide.take(word)
    high <<= _u(1)
    high <<= _u(63) - shift
    high |= low
    return high


def _tiny(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 to 3 bytes."""
    first, middle, last = x & _u(255), x >> ((size >> _u(1)) << _u(3)) & _u(255), x >> ((size - _u(1)) << _u(3)) & _u(255)
    h = (first << _u(16) | middle << _u(24) | last | size << _u(8)) ^ ((_SECRET[0] & _LOW) ^ (_SECRET[0] >> _u(32)))
    h = (h ^ h >> _u(33)) * _BYTE
    h = (h ^ h >> _u(29)) * _LAST
    return h ^ h >> _u(32)


def _short(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """4 to 8 bytes."""
    h = (x >> ((size - _u(4)) << _u(3)) & _LOW | x << _u(32)) ^ (_SECRET[1] ^ _SECRET[2])
    h ^= (h << _u(49) | h >> _u(15)) ^ (h << _u(24) | h >> _u(40))
    h *= _SHORT
    h ^= (h >> _u(35)) + size
    h *= _SHORT
    return h ^ h >> _u(28)


def _long(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """9 to 16 bytes, of which x are the first eight and y the last eight."""
    x, y = x ^ (_SECRET[3] ^ _SECRET[4]), y ^ (_SECRET[5] ^ _SECRET[6])
    a, b, c, d = x & _LOW, x >> _u(32), y & _LOW, y >> _u(32)
    cross = (a * c >> _u(32)) + (b * c & _LOW) + a * d
    high = (b * c >> _u(32)) + (cross >> _u(32)) + b * d
    h = size + x.byteswap() + y + (high ^ x * y)
    h = (h ^ h >> _u(37)) * _LONG
    return h ^ h >> _u(32)


def hashes(words) -> np.ndarray:
    """The hash of every word of an Arrow binary array without nulls or empty words."""
    import pyarrow as pa
    import xxhash

    out = np.zeros(len(words), np.uint64)
    if not len(words):
        return out
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    low = int(ends[0])
    ends -= low
    wide = np.zeros((int(ends[-1]) >> 3) + 3, "<u8")
    wide.view(np.uint8)[: ends[-1]] = np.frombuffer(data, np.uint8)[low : low + int(ends[-1])]
    kinds = np.digitize(np.arange(MOST + 2), (4, 9, MOST + 1)).astype(np.uint8)
    rest = []
    for low in range(0, len(out), BLOCK):
        begin, end = ends[low : min(low + BLOCK, len(out))], ends[low + 1 : low + 1 + BLOCK]
        size = end - begin
        kind = kinds.take(size, mode="clip")
        x, size = _eight(wide, begin), size.astype(np.uint64)
        for k, made in enumerate((_tiny, _short, _long)):
            at = np.flatnonzero(kind == k)
            more = (_eight(wide, end.take(at) - 8),) if made is _long else ()
            out[low + at] = made(x.take(at), *more, size.take(at))
        rest.append(low + np.flatnonzero(kind == 3))
    at = np.concatenate(rest)
    if len(at):
        coded = words.take(pa.array(at)).dictionary_encode()
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        out[at] = each.take(coded.indices.to_numpy())
    return out
