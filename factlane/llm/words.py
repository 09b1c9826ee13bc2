"""Vectorised word kernels shared by the corpus operators.

Texts arrive as Arrow string arrays.  Words are found with byte tables (every delimiter is ASCII, so
UTF-8 sequences are never split) and hashed 64 bits wide with numpy, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 22

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _delimiters(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Words are runs of anything but ASCII white space.
SPACED = _delimiters(SPACES)
#: Words are runs of digits, lower-case letters and non-ASCII characters (after lower-casing A-Z).
ALNUM = _delimiters(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """The words of a block of texts: byte ranges in ``data`` and, per text, ranges of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n_texts + 1 offsets into starts / ends
    texts: np.ndarray  # n_texts + 1 offsets into data

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def find(texts: pa.Array, delimiters: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, at = buffers(texts)
    if lower:
        data = LOWER[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(at), np.int64), at)
    inside = ~delimiters[data]
    opens, closes = inside.copy(), inside.copy()
    bounds = at[:-1][np.diff(at) > 0]
    opens[1:] &= ~inside[:-1]
    opens[bounds] = inside[bounds]
    closes[:-1] &= ~inside[1:]
    lasts = np.append(bounds[1:], len(data)) - 1
    closes[lasts] = inside[lasts]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at), at)


_SEED = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20260101))
_BYTE = [_rng.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2)]
_P = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_Q = (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, dtype=U64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if len(have) <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a copy)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def hashes(words: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(words), U64)
    base, table = _P[which], _BYTE[which]
    i, n = 0, len(words)
    with np.errstate(over="ignore"):
        while i < n:
            lo = words.starts[i]
            j = max(i + 1, int(np.searchsorted(words.ends, lo + PIECE, "right")))
            hi = words.ends[j - 1]
            total = np.empty(hi - lo + 1, U64)
            total[0] = 0
            np.cumsum(table[words.data[lo:hi]] * powers(base, hi - lo), out=total[1:])
            a, b = words.starts[i:j] - lo, words.ends[i:j] - lo
            out[i:j] = (total[b] - total[a]) * powers(inverse(base), hi - lo)[a] + (b - a).astype(U64) * U64(_SEED)
            i = j
    return mix(out)


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` consecutive hashes; entry i covers h[i : i + size]."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    base = _Q[which]
    with np.errstate(over="ignore"):
        for i in range(0, n, PIECE):
            part = h[i : min(n, i + PIECE) + size - 1]
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(part * powers(base, len(part)), out=total[1:])
            m = len(part) - size + 1
            out[i : i + m] = (total[size:] - total[:m]) * powers(inverse(base), m)
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word indexes at which ``size`` words of one text begin."""
    total = int(first[-1])
    ok = np.ones(total, bool)
    for k in range(1, size):
        at = first[1:] - k
        ok[at[at >= first[:-1]]] = False
    return np.flatnonzero(ok)


def cuts(keys: np.ndarray, n_buckets: int, width: int = 64) -> np.ndarray:
    """Where each of n_buckets equal ranges of hashes of ``width`` bits begins in sorted keys."""
    step = -(-(1 << width) // n_buckets)
    bounds = np.minimum(np.arange(n_buckets + 1, dtype=object) * step, (1 << width) - 1).astype(np.uint64)
    out = np.searchsorted(keys, bounds)
    out[-1] = len(keys)
    return out


#: Entries of a batch in one bucket below which more buckets would cost more in rows than they save in memory.
ROW_ENTRIES = 256
#: Bytes of text in a batch: PIECE, more for corpora of over 2,048 such, up to LARGEST.
LARGEST = 64 * PIECE


def batch_size(total: int) -> int:
    """Bytes of text in a batch for a corpus of about ``total`` bytes: a corpus has 2,048 batches before they grow."""
    return min(LARGEST, max(PIECE, total // 2048))


def bucket_count(partitions: int, batches: int, batch_bytes: int) -> int:
    """Buckets for entries of hashed words: about two batches' worth in each, so that a bucket fits a task, but never so
    many that a batch's rows hold fewer than ROW_ENTRIES of them; batches grow with the corpus (see batch_size)."""
    return max(partitions, min(batches // 2, batch_bytes // (6 * ROW_ENTRIES)))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = PIECE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows in order, in slices of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def merged_blocks(batches: Iterator[pa.RecordBatch], limit: int = PIECE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """As ``blocks``, with small neighbours of one task put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in blocks(batches, limit, column):
        here = int(buffers(part.column(part.schema.get_field_index(column)))[1][-1])
        if held and size + here > limit:
            yield _one(held)
            held, size = [], 0
        held.append(part)
        size += here
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def long_ids(column: pa.Array) -> np.ndarray:
    """int64 ids; a null id becomes the largest value (see NULL_ID)."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


NULL_ID = np.iinfo(np.int64).max


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)
