"""Tokens of whole texts as flat numpy arrays, for use inside Arrow tasks.

A batch of texts becomes one run of word codes with the bounds of each text. All work is done by
Arrow and numpy kernels over the batch, so no Python loop touches single words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once. A longer single text makes a slice of its own.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def lower_table() -> bytes:
    """Byte map that lower-cases A-Z and nothing else."""
    return bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_table() -> bytes:
    """Byte map that lower-cases A-Z and blanks all ASCII but letters and digits."""
    return bytes(
        c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
        for c in range(256)
    )


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most `most` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start, used = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, used + most, "right")))
        yield batch.slice(start, stop - start)
        start, used = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8) of all values in one array, and their n + 1 bounds; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of a slice: codes into `names`, byte starts, and the n + 1 word bounds of the texts."""

    codes: np.ndarray
    names: list[bytes]
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word in order; equal in all tasks."""
        names = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names))
        return names[self.codes] if len(names) else np.zeros(0, np.uint64)


def words(column: pa.Array, table: bytes | None = None) -> Words:
    """Split texts at ASCII white space after mapping their bytes by `table`."""
    raw, bounds = text_bytes(column)
    if table is not None:
        raw = np.frombuffer(raw.tobytes().translate(table), np.uint8)
    inside = ~_SPACE[raw]
    # A word starts where the byte before is white space or belongs to the text before.
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    # The words without their gaps, as one Arrow string array.
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())]
    )
    encoded = array.dictionary_encode()
    return Words(
        encoded.indices.to_numpy(), encoded.dictionary.to_pylist(), starts, ends,
        np.searchsorted(starts, bounds),
    )


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of a common 64-bit hash)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words within a text, and the n + 1 bounds of the texts.

    A text of fewer words has none.
    """
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    rolled = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    return rolled, out
