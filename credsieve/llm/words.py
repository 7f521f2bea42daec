"""Words and word shingles of a column of texts, as 64-bit hashes, computed on whole buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Text that is worked on at once.
BLOCK_BYTES = 2 << 20
#: Bytes over which powers of the hash's base run; longer texts start over, so the table never grows.
SEGMENT = 1 << 17

_BASE = np.uint64(0x9E6C63D0676A9A99)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64) -> np.ndarray:
    steps = np.full(SEGMENT, base)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the words of data between starts and ends; equal words have equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        a = int(starts[w])
        z = int(np.searchsorted(ends, a + SEGMENT, side="right"))
        if z == w:  # a word longer than a segment
            total = 0
            for k in range(a, int(ends[w]), SEGMENT):
                part = data[k : min(k + SEGMENT, int(ends[w]))].astype(np.uint64)
                total += int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), k - a, 1 << 64)
            out[w] = (total + int(ends[w]) - a) & ((1 << 64) - 1)
            w += 1
            continue
        part = data[a : int(ends[z - 1])].astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _UP[: len(part)], out=sums[1:])
        s, e = starts[w:z] - a, ends[w:z] - a
        out[w:z] = (sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64)
        w = z
    return mix(out)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK_BYTES of text each, with one row at least."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BLOCK_BYTES)))
        yield a, min(z, len(sizes))
        a = z


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts and ends (one offset more than texts); null is empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the buffer, the number of the first word of each text (one more than texts), and hashes.

    to: what each byte becomes; 0 ends a word.
    """
    data, at = buffer_of(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64)
    data = to[data]
    inside = data != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][np.diff(at) > 0]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at), _hashes(data, starts, ends)


def byte_map(lower: bool, is_word) -> np.ndarray:
    """A table for words_of: bytes of words (A-Z as a-z if lower), shifted so that none but a separator is 0."""
    out = np.zeros(256, np.uint16)
    for b in range(256):
        if is_word(b + 32 if lower and 65 <= b <= 90 else b):
            out[b] = (b + 32 if lower and 65 <= b <= 90 else b) + 1
    return out


#: Words between blanks (20, 09-0D), A-Z in lower case.
BLANK_WORDS = byte_map(True, lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of 0-9, a-z and everything beyond ASCII, A-Z in lower case.
LETTER_WORDS = byte_map(True, lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_SALTS = mix(np.arange(1, 65, dtype=np.uint64))


def shingles_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; with fewer words the whole run; nothing without words."""
    n = len(hashes)
    if not n:
        return hashes
    width, count = (k, n - k + 1) if n >= k else (n, 1)
    total = np.full(count, np.uint64(width))
    for i in range(width):
        total = (total ^ hashes[i : i + count]) * (_SALTS[i % 64] | np.uint64(1))
        total ^= total >> np.uint64(29)
    return mix(total)
