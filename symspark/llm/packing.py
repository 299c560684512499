"""Columns of integers packed for a shuffle, and sums of bounded arrays over all tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .textops import U64

#: Entries of an array that travel together.
RANGE = 4096


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, non-negative, the first in rising order; it is kept as differences, all as planes of bytes."""
    out = [struct.pack("<QB", len(columns[0]), len(columns))]
    for k, column in enumerate(columns):
        x = column.astype(U64)
        if k == 0 and len(x):
            x[1:] = x[1:] - x[:-1]
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out.append(bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:width]).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, columns = struct.unpack_from("<QB", raw)
    at, out = 9, []
    for k in range(columns):
        width = raw[at]
        planes = np.zeros((n, 8), dtype=np.uint8)
        planes[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=at + 1).reshape(width, n).T
        x = planes.reshape(-1).view(U64)
        out.append(np.cumsum(x, dtype=U64) if k == 0 else x)
        at += 1 + width * n
    return out


def array_rows(arrays: list[np.ndarray]) -> pa.RecordBatch:
    """A task's share of some arrays of counts, as rows (slot, blob): array k in ranges, without those that are all zero."""
    slots, blobs = [], []
    for k, x in enumerate(arrays):
        for i in range(0, len(x), RANGE):
            part = x[i : i + RANGE]
            at = np.flatnonzero(part)
            if len(at):
                slots.append((k << 32) | (i // RANGE))
                blobs.append(pack(at, part[at]))
    return pa.RecordBatch.from_arrays([pa.array(slots, type=pa.int64()), pa.array(blobs, type=pa.binary())], names=["slot", "blob"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            at, n = unpack(blob.as_py())
            sums.setdefault(slot, np.zeros(RANGE, dtype=np.int64))[at.astype(np.int64)] += n.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int64()), pa.array([x.tobytes() for x in sums.values()], type=pa.binary())], names=["slot", "blob"])


def sum_arrays(rows: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The sums over all tasks of arrays of the given, bounded sizes; ranges are summed apart before they meet on the driver."""
    out = [np.zeros(n, dtype=np.int64) for n in sizes]
    for r in rows.select("slot", "blob").repartition("slot").mapInArrow(_summed, "slot long, blob binary").collect():
        x, i = np.frombuffer(r.blob, dtype=np.int64), (r.slot & 0xFFFFFFFF) * RANGE
        mine = out[r.slot >> 32][i : i + RANGE]
        mine += x[: len(mine)]
    return out
