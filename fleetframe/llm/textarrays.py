"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes and rolling windows.

Every function works on a *chunk*: the concatenated UTF-8 bytes of whole texts and their
offsets. Texts are never cut; a chunk holds one text at least and about ``CHUNK_BYTES``
otherwise, which bounds the memory of the eight-byte arrays made from it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20
NULL_ID = -(2**63)
"""A missing doc_id sorts before all others and counts as this number."""
RANGE_BYTES = 32 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240229


class Chunk(NamedTuple):
    first: int
    """Row of the batch at which the chunk begins."""
    data: np.ndarray
    offsets: np.ndarray


def text_key(doc_id: str, text: str) -> Column:
    """One long for each distinct (id, text); repeated rows share it and get equal results."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def order_id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def range_count(texts: DataFrame, column: str = "text", limit: int = RANGE_BYTES) -> int:
    """Hash ranges for an exchange over all texts: one for each ``limit`` bytes, at least 8."""
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(8, -(-int(total) // limit))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts (a null text is empty) in groups of about ``limit`` bytes."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Chunk(row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``limit`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(row, end - row)
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of an unsigned 64-bit array, in place."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def byte_values() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**64, 256, np.uint64) | U(1)


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    """Number of the word's text within the chunk."""


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z made a-z."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def split_words(chunk: Chunk, breaks: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes outside ``breaks``, never across texts."""
    inside = ~breaks[chunk.data]
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = chunk.offsets[:-1]
    before[edges[edges < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = chunk.offsets[1:] - 1
    after[last[(last >= 0) & (np.diff(chunk.offsets) > 0)]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(chunk.offsets, starts, "right") - 1)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes, from prefix sums of a polynomial hash."""
    n = len(data)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers[:n], out=sums[1:])
    powers[1:] = U(pow(_BASE, -1, 2**64))
    powers[0] = 1
    np.cumprod(powers, out=powers)
    value = (sums[words.ends] - sums[words.starts]) * powers[words.starts]
    return mix(value + (words.ends - words.starts).astype(np.uint64))


def rolling(hashes: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (also across texts: see ``within``)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(seed)
        out += hashes[j:n + j]
    return mix(out)


def within(text: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``k`` lie in one text."""
    return text[:max(0, len(text) - k + 1)] == text[k - 1:]


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def pieces(table_part: np.ndarray, arrays: dict[str, np.ndarray], shared: dict[str, bytes]) -> Iterator[dict]:
    """One row for each hash range: its entries as packed bytes, next to ``shared`` values."""
    order = np.argsort(table_part, kind="stable")
    table_part = table_part[order]
    cuts = np.flatnonzero(np.diff(table_part)) + 1
    bounds = [0, *cuts.tolist(), len(table_part)]
    sorted_arrays = {k: v[order] for k, v in arrays.items()}
    if len(table_part) == 0:
        return
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield {"part": int(table_part[a]), **shared, **{k: v[a:b].tobytes() for k, v in sorted_arrays.items()}}


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of each value, from its upper bits; uses no low bits."""
    return (((hashes >> U(40)) * U(parts)) >> U(24)).astype(np.uint32)


def unpack(cells: Iterable, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed cells one after the other, and each cell's length."""
    cells = [c.as_buffer() if hasattr(c, "as_buffer") else c for c in cells]
    parts = [np.frombuffer(c, kind) for c in cells]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def give_back() -> None:
    """Return freed memory to the system: workers live on in later stages, and what a task took must not stay with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def batches_of(rows: Iterable[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``limit`` bytes of packed cells."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
    give_back()
