"""Filters and counters of fixed size: filled by tasks in parts, combined by part, and small enough for the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm import textnum

PARTS = 64


def reduced(rows: DataFrame, raw: type, dtype: type, combine: Callable) -> np.ndarray:
    """Combines vectors that come in ``PARTS`` numbered parts: within tasks, then by part."""

    def run(batches: Iterator[pa.RecordBatch], raw: type) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column("part").to_pylist(), batch.column("counts")):
                x = np.frombuffer(values.as_buffer(), raw).astype(dtype)
                held[part] = combine(held[part], x) if part in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    parts = rows.select("part", "counts").mapInArrow(lambda x: run(x, raw), schema).repartition(PARTS, "part").mapInArrow(lambda x: run(x, dtype), schema).collect()
    return np.concatenate([np.frombuffer(r.counts, dtype) for r in sorted(parts, key=lambda r: r.part)]) if parts else np.zeros(0, dtype)


def in_parts(vector: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(vector, PARTS)]


_FILTER_BYTES = 1 << 22


def _bits(name: bytes) -> tuple[int, int]:
    return int.from_bytes(name[:8], "little") % (8 * _FILTER_BYTES), int.from_bytes(name[8:], "little") % (8 * _FILTER_BYTES)


def may_hold(bits: np.ndarray, name: bytes) -> bool:
    return len(bits) > 0 and all(bits[b >> 3] >> (b & 7) & 1 for b in _bits(name))


def filter_of(rows: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size that may hold the names in a binary column of 16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_FILTER_BYTES, np.uint8)
        for batch in batches:
            for name in batch.column(column).to_pylist():
                for b in _bits(name):
                    bits[b >> 3] |= 1 << (b & 7)
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(in_parts(bits), pa.binary())], ["part", "counts"])

    return reduced(rows.select(column).mapInArrow(textnum.lean(run), "part int, counts binary"), np.uint8, np.uint8, np.bitwise_or)
