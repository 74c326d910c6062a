"""Bloom filters of hash columns: built in executors, of a fixed size whatever they hold, handed out as broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from cuesmith.llm.memory import tidy
from cuesmith.llm.shingles import spread

#: Bits of one piece of a filter; pieces are put together by different tasks.
PIECE = 19


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = spread(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return (x >> np.uint64(64 - bits)).astype(np.int64), (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def maybe_in(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _probes(hashes, len(packed).bit_length() + 2)
    return ((packed[a >> 3] >> (a & 7)) & (packed[b >> 3] >> (b & 7)) & 1).astype(bool)


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """The packed bits (2**bits, two probes a hash) of a one-column table of longs. Each task sets bits of its own
    rows, a piece of 64 KB is put together in one place, and the driver gets 2**(bits - 19) pieces."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64), bits)))
            ends = np.searchsorted(at >> PIECE, np.arange((1 << max(0, bits - PIECE)) + 1))
            rows = [(i, (at[a:z] & ((1 << PIECE) - 1)).astype("<u4").tobytes()) for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["piece", "data"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces.setdefault(i, np.zeros(1 << PIECE, bool))[np.frombuffer(x.as_buffer(), "<u4")] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([np.packbits(p, bitorder="little").tobytes() for p in pieces.values()], pa.binary())], ["piece", "data"])

    made = hashes.mapInArrow(tidy(mark), "piece int, data binary").repartition(8, "piece").mapInArrow(tidy(put), "piece int, data binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (PIECE - 3)
    for r in made.collect():
        out[r.piece * size : (r.piece + 1) * size] = np.frombuffer(r.data, np.uint8)[: len(out)]
    return out


def shared_bloom(hashes: DataFrame, bits: int) -> Broadcast:
    """bloom() as a broadcast; the caller destroys it after its last use."""
    return hashes.sparkSession.sparkContext.broadcast(bloom(hashes, bits))
