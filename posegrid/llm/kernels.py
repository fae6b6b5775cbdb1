"""Vectorised text kernels: word boundaries and word hashes of many texts at once, in numpy.

A batch of texts is one byte array and its offsets, as Arrow holds it. Work goes by chunks of
whole texts of about CHUNK bytes, so the memory of a task follows the chunk and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MULT = U(0x9E3779B97F4A7C15 | 5)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_AT = mix64(np.arange(64 * 256, dtype=U) + U(0x1234567))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], together: str | None = None, text: str = "text") -> Iterator[pa.Table]:
    """Slices of batches with about CHUNK bytes each. Neighbouring rows with one value of the
    column `together` are never parted, even across batches."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        _, offs = bytes_of(table[text])
        ids = table[together].to_numpy(zero_copy_only=False) if together else None
        if held and ids is not None and held[-1][together][-1].as_py() != ids[0]:
            yield pa.concat_tables(held)
            held = []
        at = 0
        while at < table.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK, "right")) - 1)
            if ids is not None:
                while to < table.num_rows and ids[to] == ids[to - 1]:
                    to += 1
            held.append(table.slice(at, to - at))
            at = to
            if at < table.num_rows or ids is None:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def split_words(data: np.ndarray, offs: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it is in. word: which bytes are of words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    own = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = own[:-1]
    starts = np.flatnonzero(own & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = own[1:]
    ends = np.flatnonzero(own & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 200_000) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a sum of random words by (byte, place), then mixed."""
    out = np.zeros(len(starts), U)
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        lens = e - s
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(lens.sum()) - np.repeat(first, lens)
        h = _BYTE_AT[((place & 63) << 8) | data[place + np.repeat(s, lens)]]
        if lens.max() > 64:
            far = place >= 64
            h[far] = mix64(h[far] + (place[far] >> 6).astype(U))
        out[a : a + step] = mix64(np.add.reduceat(h, first) + lens.astype(U))
    return out


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n_rows: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's words (those in keep) joined by single spaces."""
    if keep is not None:
        starts, ends, row = starts[keep], ends[keep], row[keep]
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(n_rows + 1, np.int64)
    inner = np.zeros(len(data) + 1, np.int8)
    inner[starts] += 1
    inner[ends] -= 1
    take = np.cumsum(inner[:-1]).astype(bool)
    data = data.copy()
    gap = ends[:-1][row[:-1] == row[1:]]
    data[gap] = 0x20
    take[gap] = True
    size = ends - starts
    size[:-1] += row[:-1] == row[1:]
    offs = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(row, size, n_rows).astype(np.int64), out=offs[1:])
    return data[take], offs


def strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
