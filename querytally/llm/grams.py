"""Array helpers for tasks: texts as byte buffers, words, and their hashes."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def worker_cache(key, make):
    """What ``make()`` returned first in this Python worker; tasks of one worker share it."""
    store = vars(sys).setdefault("_querytally_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def byte_slices(column, limit=SLICE_BYTES):
    """Row ranges of a text column with about ``limit`` bytes each, one row at least.

    Yields (first row, bytes, offsets); a null text has no bytes.
    """
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def mix(x):
    """Finalizer that spreads every input bit over all 64 (splitmix64)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def seeded(seed, n):
    """n reproducible 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _BASE)


def _powers(n):
    size = 1 << max(16, int(n).bit_length())
    known = vars(sys).setdefault("_querytally_worker", {}).get("powers")
    if known is None or len(known[0]) < size:
        inverse = pow(int(_BASE), -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        known = np.multiply.accumulate(up), np.multiply.accumulate(down)
        vars(sys)["_querytally_worker"]["powers"] = known
    return known


class Ranges:
    """Hashes of byte ranges of one buffer in constant time each."""

    def __init__(self, data):
        table = worker_cache("byte table", lambda: seeded(7, 256))
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(table[data] * up[:len(data)], out=self._sums[1:])

    def hash(self, starts, ends):
        with np.errstate(over="ignore"):
            h = (self._sums[ends] - self._sums[starts]) * self._down[starts]
            return mix(h + (np.asarray(ends) - np.asarray(starts)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _word_bytes():
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def lowered(data):
    """A-Z as a-z; other bytes, multi-byte letters among them, stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def trigrams(texts, table, bits, skip=None):
    """Buckets of each text's byte trigrams in order, and the offset of each text in them.

    Bytes are first replaced by ``table``; a text counts with a space before and after it.
    """
    data = table[np.frombuffer(b"".join([b" " + t + b" " for t in texts]), np.uint8)].astype(np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts], dtype=np.int64)])
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    code = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    use = np.ones(len(code), bool) if skip is None else code != skip
    inner = edges[1:-1]
    use[inner - 1] = False  # these reach into the next text
    use[inner - 2] = False
    places = np.flatnonzero(use)
    with np.errstate(over="ignore"):
        buckets = (code[places] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return buckets.astype(np.int64), np.searchsorted(places, edges)


def words(data, offsets):
    """Starts and ends of the words, and each text's first word number."""
    inside = _word_bytes()[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    before = offsets[1:][offsets[1:] > 0] - 1
    stop[before] = inside[before]
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_hashes(data, starts, ends):
    """A 64-bit hash of each word that ``words`` found.

    Every byte gives a number of its own for each place in a word, and a word is the sum of its bytes' numbers:
    unlike a polynomial modulo a power of two, this has no words that always agree.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = (ends - starts).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    inside = data[_word_bytes()[data]].astype(np.uint64)  # the words' bytes, one word after the other
    with np.errstate(over="ignore"):
        numbers = mix((place.astype(np.uint64) << np.uint64(8) | inside) * _BASE + np.uint64(0x632BE59BD9B4E019))
        return mix(np.add.reduceat(numbers, first) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(word_hashes, k):
    """Hashes of k consecutive words; of all words if there are fewer."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            out = mix(out * _BASE + word_hashes[i:n - width + 1 + i])
    return out
