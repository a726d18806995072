"""Arrays of numbers sent between tasks as compressed packets, one row for each (task, part), not one for each number.

The senders sort by a hash and cut at the borders of the parts, so that a part is a range of the hash and holds its
share of the keys whatever the corpus looks like. Spark does the shuffle; numpy works inside tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

SCHEMA = "part int, payload binary"
_DTYPES = ["uint64", "int64", "uint32", "int32", "uint16", "uint8", "float64"]


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays by planes of equal significance, which compress well where values are small or sorted differences."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        head.append(struct.pack("<Bq", _DTYPES.index(a.dtype.name), len(a)))
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    count, at, shapes = data[0], 1, []
    for _ in range(count):
        kind, n = struct.unpack_from("<Bq", data, at)
        shapes.append((np.dtype(_DTYPES[kind]), n))
        at += 9
    raw, arrays, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:]), dtype=np.uint8), [], 0
    for dtype, n in shapes:
        size = n * dtype.itemsize
        arrays.append(np.ascontiguousarray(raw[at : at + size].reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.empty(0, dtype))
        at += size
    return arrays


def steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value first; ``np.cumsum`` undoes it."""
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0)) if len(sorted_values) else sorted_values


def borders(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted 64-bit hashes, and the end."""
    first = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, first), len(sorted_hashes))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_id(ids: np.ndarray) -> np.ndarray:
    """The hash that deals document ids to parts."""
    return mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["part", "payload"])


def cut_parts(sorted_hashes: np.ndarray, parts: int, payload: Callable[[slice], bytes]) -> pa.RecordBatch:
    """A packet for each part that has rows."""
    edges = borders(sorted_hashes, parts)
    return rows([(p, payload(slice(edges[p], edges[p + 1]))) for p in range(parts) if edges[p] < edges[p + 1]])


def exchanged(packets: DataFrame, parts: int, work: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on all packets of each part; a task has one part."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for batch in batches for x in batch.column("payload").to_pylist()]
        if found:
            yield from work(found)

    return packets.repartitionById(parts, "part").select("payload").mapInArrow(gathered, schema)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: the same borders as ``borders``."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def beside(streamed: DataFrame, held: DataFrame, parts: int, work: Callable[[list[bytes], Iterator[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(payloads of held, payloads of streamed)`` for each part that has any; what is streamed passes by once."""
    both = held.select("part", "payload").withColumn("late", F.lit(0)).unionByName(streamed.select("part", "payload").withColumn("late", F.lit(1)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[bytes] = []
        rest = ((late, data.as_py()) for batch in batches for late, data in zip(batch.column("late").to_pylist(), batch.column("payload")))
        first = None
        for late, data in rest:
            if late:
                first = data
                break
            kept.append(data)
        if first is not None:
            yield from work(kept, chain([first], (data for _, data in rest)))

    return both.repartitionById(parts, "part").sortWithinPartitions("late").select("late", "payload").mapInArrow(told, schema)
