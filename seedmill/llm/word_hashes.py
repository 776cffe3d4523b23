"""64-bit hashes of the words of texts, worked out on the bytes of whole Arrow columns.

Words are runs without blank, tab, line feed, vertical tab, form feed and
carriage return. A word's hash is a polynomial of its bytes, taken as the
difference of two running sums, so no word becomes a Python object. Different
words share a hash with a chance of about 1 in 2**64 a pair.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        size = max(size, BLOCK_BYTES)
        _powers[:] = [
            np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, b, dtype=np.uint64)))
            for b in (BASE, INVERSE)
        ]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_block(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block and the place where each begins."""
    inside = ~BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[doc_starts] = inside[doc_starts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    breaks = ~inside
    breaks[doc_starts] = True
    breaks = np.append(np.flatnonzero(breaks), len(data))
    ends = breaks[np.searchsorted(breaks, starts, side="right")]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _long_text(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, block by block; a block ends at a blank."""
    found, start = [], 0
    while start < len(data):
        stop = min(len(data), start + BLOCK_BYTES)
        if stop < len(data):
            blanks = np.flatnonzero(BLANK[data[start:stop]])
            while not len(blanks) and stop < len(data):  # one word longer than the block
                stop = min(len(data), stop + (stop - start))
                blanks = np.flatnonzero(BLANK[data[start:stop]])
            if stop < len(data):
                stop = start + int(blanks[-1]) + 1
        found.append(_hash_block(data[start:stop], np.array([0]))[0])
        start = stop
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, hashes, counts) for runs of texts: all their words in order, and the words of each text.

    Null texts are empty. With ``lower`` the letters A to Z count as a to z.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        block = data[offsets[first] : offsets[end]]
        block = LOWER[block] if lower else block
        if end == first + 1:
            hashes = _long_text(block)
            yield first, end, hashes, np.array([len(hashes)])
        else:
            starts = offsets[first:end] - offsets[first]
            hashes, places = _hash_block(block, np.unique(starts[starts < len(block)]))
            doc = np.searchsorted(starts, places, side="right") - 1
            yield first, end, hashes, np.bincount(doc, minlength=end - first)
        first = end
