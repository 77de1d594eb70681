"""Words and shingles of many texts at once, as 64-bit hashes computed over the UTF-8 bytes with numpy.

A word's hash adds up a product for each byte, a random value of the byte times a random odd value of its place in the word,
and mixes the sum with the length. Unlike a polynomial in the place, no pattern of letters makes two words meet by
design; two different words or shingles get the same hash with a chance of about 2**-64 a pair, which is the only place
where these functions aren't exact.

Texts are worked on in runs of a quarter of a megabyte, a longer one alone; a run takes some fifty bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Values of the first places of a word; those of later ones are worked out when a word is that long.
_PLACES = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_code = np.arange(256)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = ((_code >= 48) & (_code <= 57)) | ((_code >= 97) & (_code <= 122)) | (_code >= 128)
#: [^\x20\x09-\x0D]
SOLID = ~((_code == 32) | ((_code >= 9) & (_code <= 13)))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def _places(first: int, last: int) -> np.ndarray:
    """Random odd value of each place of a word."""
    return mix((np.arange(first, last, dtype=np.uint64) + np.uint64(1)) * _STEP) | np.uint64(1)


_PLACE = _places(0, _PLACES)


def hash_spans(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end of spans that are in order and don't overlap; value: of each byte of the text, from _BYTE."""
    if not len(start):
        return np.zeros(0, np.uint64)
    span = np.diff(start, append=len(value))
    nth = np.arange(start[0], len(value), dtype=np.int32) - np.repeat(start.astype(np.int32), span)
    place = _PLACE if (longest := int(span.max())) <= _PLACES else np.concatenate((_PLACE, _places(_PLACES, longest)))
    total = np.zeros(len(nth) + 1, np.uint64)
    np.cumsum(value[start[0] :] * place[nth], out=total[1:])
    return mix(total[end - start[0]] - total[start - start[0]] + (end - start).astype(np.uint64) * _STEP)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and len + 1 offsets into them; null counts as empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def pieces(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts of about size bytes."""
    data, at = utf8(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of each word, and len(at) offsets of texts into the words.

    kind says which bytes, after lower-casing A-Z, are part of words (ALNUM or SOLID)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(at), np.int64)
    b = LOWER[data]
    part = kind[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    first = part.copy()
    first[1:] &= ~part[:-1] | edge[1:-1]
    last = part.copy()
    last[:-1] &= ~part[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_spans(_BYTE[b], start, end), start, end, np.searchsorted(start, at)


def shingles(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places are left out, and text borders don't count."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _STEP
        out += hashed[j : j + n]
    return mix(out + np.uint64(k))


def shingle_sets(hashed: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text (all its words as one where it has fewer), and offsets of texts into them."""
    n = len(bounds) - 1
    count = np.diff(bounds)
    whole = shingles(hashed, k)
    text = np.repeat(np.arange(n), np.maximum(count - k + 1, 0))
    inside = np.concatenate(([0], np.cumsum(np.maximum(count - k + 1, 0))))
    place = np.arange(len(text)) - inside[text] + bounds[text]
    found = [(text, whole[place])]
    for short in range(1, k):
        if len(own := np.flatnonzero(count == short)):
            h = np.zeros(len(own), np.uint64)
            for j in range(short):
                h = h * _STEP + hashed[bounds[own] + j]
            found.append((own, mix(h + np.uint64(short))))
    text, value = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[keep], value[keep]
    return value, np.searchsorted(text, np.arange(n + 1))
