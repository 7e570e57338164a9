"""Words and their hashes, for whole Arrow batches of texts at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D, the same as ``[^\\x20\\x09-\\x0D]+`` over
characters, because no byte of a longer UTF-8 sequence is in that set; ``bytes.split`` cuts at the
same bytes. Hashes are keyed 64-bit hashes of whole words, and mixed combinations of
these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are taken in blocks of about so many bytes (one text at least), which bounds the arrays.
BLOCK_BYTES = 1 << 19

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Key of the hash of words, and the bytes that are taken as numbers; longer words are hashed one by one.
WORD_SEED, NUMBER_BYTES = 0x5851F42D4C957F2D, 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one entry more). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``limit`` bytes of text, each with its bytes and offsets."""
    for batch in batches:
        data, off = as_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[off[first] : off[last]], off[first : last + 1] - off[first]
            first = last
        del batch, data
        pa.default_memory_pool().release_unused()


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word, and the first word of each text (one entry more)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[0] = after[-1] = True
    inner = off[(off > 0) & (off < n)]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A keyed 64-bit hash of the bytes of each span, and its first and second eight bytes as numbers.

    Spans of up to ``NUMBER_BYTES`` bytes are alike if their lengths and both numbers are.
    """
    raw = np.zeros(len(data) + NUMBER_BYTES + 8, np.uint8)
    raw[: len(data)] = data
    eight = np.ndarray((len(data) + NUMBER_BYTES,), "<u8", raw, strides=(1,))
    size = ends - starts
    low = eight[starts] & _MASK[np.minimum(size, 8)]
    high = eight[starts + 8] & _MASK[np.clip(size - 8, 0, 8)]
    out = pair_hashes(mix(low ^ U64(WORD_SEED)), mix(high + size.astype(U64) * _LEFT))
    for k in np.flatnonzero(size > NUMBER_BYTES).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]], WORD_SEED)
    return out, low, high


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A keyed 64-bit hash of the bytes of each word, and the first word of each text (one entry more)."""
    starts, ends, first = words(data, off)
    if not len(starts):
        return np.zeros(0, U64), first
    return span_numbers(LOWER[data] if lower else data, starts, ends)[0], first


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges of ``size`` that start at ``begin``, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def pair_hashes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _LEFT + (y << U64(31) | y >> U64(33)) * _RIGHT)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each ``width`` consecutive hashes, across texts too: callers leave those out.

    Two windows of half the width make one, mixed at every step, so no sum over a window exists that
    words of a chosen structure could cancel.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have = mix(hashes), 1
    while have < width:
        step = min(have, width - have)
        out = pair_hashes(out[: len(out) - step], out[step:])
        have += step
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the first word of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words at which a window of ``width`` words of one text starts."""
    n = int(first[-1])
    if n < width:
        return np.zeros(0, np.int64)
    starts = np.arange(n - width + 1)
    of = owners(first)
    return starts[of[: n - width + 1] == of[width - 1 :]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
