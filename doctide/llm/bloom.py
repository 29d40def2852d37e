"""Bloom filters of bounded size, built by tasks and merged piece by piece."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
BITS_A_KEY, PIECE = 8, 1 << 21
#: Shares of the tasks whose filters are merged first.
SHARES = 32


def _bits(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(n_bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask).astype(np.int64)


class Filters:
    """Keys seen once, and keys seen twice or more, by 64-bit hash."""

    def __init__(self, n_bits: int):
        self.n_bits = n_bits
        self.once = np.zeros(n_bits >> 3, np.uint8)
        self.twice = np.zeros(n_bits >> 3, np.uint8)

    def _set(self, table: np.ndarray, places) -> None:
        for p in places:
            np.bitwise_or.at(table, p >> 3, (1 << (p & 7)).astype(np.uint8))

    @staticmethod
    def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in _bits(hashes, len(table) << 3):
            out &= (table[p >> 3] >> (p & 7)).astype(np.uint8) & 1 == 1
        return out

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        unique, counts = np.unique(hashes, return_counts=True)
        again = unique[(counts > 1) | self.has(self.once, unique)]
        self._set(self.twice, _bits(again, self.n_bits))
        self._set(self.once, _bits(unique, self.n_bits))

    def pieces(self) -> Iterator[pa.RecordBatch]:
        """The filters in pieces of PIECE bits; empty ones are left out."""
        step = PIECE >> 3
        for k in range(0, self.n_bits >> 3, step):
            o, t = self.once[k:k + step], self.twice[k:k + step]
            if o.any():
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array([k // step], pa.int32()),
                    "once": pa.array([zlib.compress(o.tobytes(), 1)], pa.binary()),
                    "twice": pa.array([zlib.compress(t.tobytes(), 1)], pa.binary()),
                })


def merge(pairs) -> tuple[np.ndarray, np.ndarray]:
    once = twice = None
    for o, t in pairs:
        if once is None:
            once, twice = o.copy(), t.copy()
        else:
            twice |= t | (once & o)
            once |= o
    return once, twice


def _merge_piece(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one piece, folded one after the other."""
    piece = once = twice = None
    for batch in rows:
        piece = batch.column("piece")[0].as_py()
        for k in range(len(batch)):
            pair = tuple(np.frombuffer(zlib.decompress(batch.column(name)[k].as_py()), np.uint8) for name in ("once", "twice"))
            once, twice = merge([pair] if once is None else [(once, twice), pair])
    yield pa.RecordBatch.from_pydict({
        "piece": pa.array([piece], pa.int32()), "once": pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()),
        "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})


PIECES = "piece int, once binary, twice binary"


def merged(pieces: DataFrame, n_bits: int, column: str) -> bytes:
    """The filter that tasks' pieces make: first those of a share of the tasks, then the shares'."""
    shares = pieces.withColumn("share", F.spark_partition_id() % SHARES).groupBy("piece", "share").applyInArrow(_merge_piece, PIECES)
    table = np.zeros(n_bits >> 3, np.uint8)
    step = PIECE >> 3
    for r in shares.groupBy("piece").applyInArrow(_merge_piece, PIECES).select("piece", column).toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(r[column])), np.uint8)
        table[r["piece"] * step:r["piece"] * step + len(part)] = part
    return zlib.compress(table.tobytes(), 1)


def _add_ids(n_bits: int):
    def run(batches):
        f = Filters(n_bits)
        for batch in batches:
            f.add(id_hashes(batch.column("id").to_numpy(zero_copy_only=False)))
        yield from f.pieces()
    return run


def id_hashes(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def among(ids: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test for ids of a table with count of them: always true for its ids, seldom for others.

    The filter's size is bounded (``MAX_BITS``); a full one lets more ids through.
    """
    n_bits = MIN_BITS
    while n_bits < min(BITS_A_KEY * 2 * count, MAX_BITS):
        n_bits *= 2
    table = merged(ids.select("id").mapInArrow(_add_ids(n_bits), PIECES), n_bits, "once")
    shared = ids.sparkSession.sparkContext.broadcast(table)
    held: dict[int, np.ndarray] = {}  # of a worker, which unpacks the filter once

    @F.arrow_udf("boolean")
    def test(column: pa.Array) -> pa.Array:
        if 0 not in held:
            held[0] = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        return pa.array(Filters.has(held[0], id_hashes(column.to_numpy(zero_copy_only=False))))

    return test
