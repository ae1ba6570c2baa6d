"""A Bloom filter of fixed size over a column of 64-bit values.

Its size is a constant (4 MB), whatever the number of values, so it may go to every executor. It only
spares work: with ever more values it lets ever more rows pass, and what it passes is joined exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.words import U, mix
from gaugeworks.llm.workspace import Workspace, tidy

LOG2_BITS = 25
HASHES = 3
FAN_IN = 16


def _place(values: np.ndarray, k: int) -> np.ndarray:
    """The bit that the k-th hash sets for each value."""
    with np.errstate(over="ignore"):
        return (mix(values + U(0x9E3779B97F4A7C15) * U(k + 1)) >> U(64 - LOG2_BITS)).astype(np.int64)


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits  # packed

    def has(self, values: np.ndarray) -> np.ndarray:
        """Which of these 64-bit values may be in the set."""
        values = values.view(U)
        left = np.arange(len(values))
        for k in range(HASHES):
            at = _place(values[left] if k else values, k)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        ok = np.zeros(len(values), bool)
        ok[left] = True
        return ok


def build(df: DataFrame, column: str) -> Bloom:
    """The filter of all values of a long column. Bitmaps are united up a tree: few of them reach the driver."""

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            values = batch.column(0).drop_null().cast(pa.int64()).to_numpy(zero_copy_only=False).view(U)
            if not len(values):
                continue
            bits = np.zeros(1 << LOG2_BITS, bool) if bits is None else bits
            for k in range(HASHES):
                bits[_place(values, k)] = True
        if bits is not None:
            yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

    @tidy
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            for raw in batch.column(0):
                got = np.frombuffer(raw.as_buffer(), np.uint8)
                bits = got.copy() if bits is None else np.bitwise_or(bits, got, out=bits)
        if bits is not None:
            yield pa.RecordBatch.from_pydict({"bits": [bits.tobytes()]})

    n = df.rdd.getNumPartitions()
    parts = df.select(F.col(column).cast("long"))
    if n > FAN_IN:
        parts = parts.coalesce(max(FAN_IN, n // FAN_IN))
    parts = parts.mapInArrow(mark, "bits binary")
    n = min(n, max(FAN_IN, n // FAN_IN))
    while n > FAN_IN:
        n = math.ceil(n / FAN_IN)
        parts = parts.repartition(n).mapInArrow(unite, "bits binary")
    total = np.zeros(1 << (LOG2_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        np.bitwise_or(total, np.frombuffer(row["bits"], np.uint8), out=total)
    return Bloom(total)


def keep_possible(df: DataFrame, column: str, bloom: Bloom, work: Workspace, name: str) -> DataFrame:
    """Rows whose value may be in the set, written; null never is."""
    where = df.columns.index(column)
    shared = df.sparkSession.sparkContext.broadcast(bloom.bits)  # 4 MB

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(shared.value)
        for batch in batches:
            ids = batch.column(where)
            ok = own.has(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            if ok.any():
                yield batch.filter(pa.array(ok))

    kept = work.keep(df.mapInArrow(run, df.schema), name)
    shared.destroy()
    return kept
