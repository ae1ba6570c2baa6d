"""Words of whole Arrow string columns, as NumPy arrays over the UTF-8 bytes.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII bytes, where Latin-1
punctuation (U+0080-00BF but for the three letters there), general punctuation (U+2000-207F) and CJK
punctuation (U+3000-303F) separate. Case is folded for ASCII and Latin-1 letters. Words are carried
as 64-bit hashes with their byte positions, so a text can be cut at word borders exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that a kernel holds in arrays at a time.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    PLACE = mix(np.arange(1, 4097, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Strings without nulls (null: empty), with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets that begin with 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about `most` bytes (one text at least), so that arrays stay small whatever a batch holds."""
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def folded(data: np.ndarray) -> np.ndarray:
    low = FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    low[upper] += 32
    return low


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run (no run is empty)."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        weight = PLACE[place] if lengths.max() <= len(PLACE) else mix((place + 1).astype(U) * U(0xD1B54A32D192ED03)) | U(1)
        values = BYTE[data[place + np.repeat(starts, lengths)]] * weight
        return mix(np.add.reduceat(values, first) + lengths.astype(U))


def run_bounds(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inside`, broken at text borders and where `cut` is set."""
    n = len(inside)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    if cut is not None:
        border[:-1] |= cut
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, byte starts and byte ends of all words (within the texts' bytes), and n + 1 word offsets by text."""
    data, offsets = buffers(texts)
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    inside = IS_WORD[data]
    p = np.flatnonzero(data == 0xC2)
    p = p[~np.isin(data[p + 1], (0xAA, 0xB5, 0xBA))]
    inside[p] = inside[p + 1] = False
    for lead, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        p = np.flatnonzero(data == lead)
        p = p[np.isin(data[p + 1], seconds)]
        inside[p] = inside[p + 1] = inside[p + 2] = False
    starts, ends = run_bounds(inside, offsets)
    return run_hashes(folded(data), starts, ends), starts, ends, np.searchsorted(starts, offsets)


#: Multipliers of the places in a shingle.
with np.errstate(over="ignore"):
    STEP = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each `size` words in a row; element i covers words i .. i + size - 1. Crosses text borders: mask."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = hashes[:n] * STEP[0]
        for i in range(1, size):
            total += hashes[i : i + n] * STEP[i % 256]
        return mix(total)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and n + 1 offsets. A text of 1 .. size - 1 words has one shingle of all its words."""
    counts = np.diff(offsets)
    many = np.maximum(counts - size + 1, 0)
    full = window_hashes(hashes, size)[ranges(offsets[:-1], many)] if many.any() else np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return full, np.concatenate([[0], np.cumsum(many)])
    total = many.copy()
    total[short] = 1
    out, at = np.zeros(int(total.sum()), U), np.concatenate([[0], np.cumsum(total)])
    is_short = np.zeros(len(out), bool)
    is_short[at[:-1][short]] = True
    out[~is_short] = full
    with np.errstate(over="ignore"):
        index = ranges(offsets[:-1][short], counts[short])
        place = index - np.repeat(offsets[:-1][short], counts[short])
        out[is_short] = mix(np.add.reduceat(hashes[index] * STEP[place], np.cumsum(counts[short]) - counts[short]) + counts[short].astype(U))
    return out, at
