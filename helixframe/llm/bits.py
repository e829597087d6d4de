"""Bit arrays of hashes, of a bounded size, that tasks are sent to leave out rows early."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import release

#: Bounds of an array's size: at most 2**28 bits (32 MB) are ever broadcast.
LEAST_BITS, MOST_BITS = 20, 28
#: Jobs that fetch an array at most: an iterator over a table runs one for each partition.
FETCHES = 12


def needed(n: int) -> int:
    """Bits of a cell number for about 16 cells an entry."""
    return max(LEAST_BITS, math.ceil(math.log2(max(1, n) * 16)))


def width(n: int) -> int:
    """The same within the bound of an array that is broadcast."""
    return min(MOST_BITS, needed(n))


def collect(cells: DataFrame, depth: int, bits: int) -> list[np.ndarray]:
    """The distinct numbers cell * depth + row of a table as a packed bit array for each row."""

    def pack(key, table):
        out = np.zeros(1 << 13, np.uint8)
        cell = table.column("cell").to_numpy() // depth
        np.bitwise_or.at(out, (cell >> 3) & 0x1FFF, (1 << (cell & 7)).astype(np.uint8))
        return pa.table({"r": pa.array([key[0].as_py()], pa.int32()), "page": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    pages = cells.select("cell", F.expr(f"int(cell % {depth})").alias("r"), F.expr(f"int(shiftright(cell div {depth}, 16))").alias("page")).groupBy("r", "page").applyInArrow(pack, "r int, page int, bits binary")
    out = [np.zeros(max(1 << 13, 1 << (bits - 3)), np.uint8) for _ in range(depth)]
    for r, page, b in pages.coalesce(FETCHES).toLocalIterator(prefetchPartitions=True):  # at most depth * 2**28 bits whatever the input is
        out[r][page << 13 : (page + 1) << 13] = np.frombuffer(bytes(b), np.uint8)
    return out


def test(array: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (array[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def cell_of(hash_column, bits: int):
    """The cell of a 64-bit hash column."""
    return F.shiftrightunsigned(hash_column, 64 - bits)


def divided(df: DataFrame, key: str, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key may be among those of keys (about n distinct ones): all that are, and few others; and the other rows. No shuffle of df."""
    bits = width(n)
    sent = df.sparkSession.sparkContext.broadcast(collect(keys.select(cell_of(F.xxhash64(key), bits).alias("cell")).distinct(), 1, bits)[0])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def part(among: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                hit = test(sent.value, batch.column(len(batch.schema) - 1).to_numpy())
                yield batch.filter(pa.array(hit == among)).select(range(len(batch.schema) - 1))
            release()

        return df.withColumn("__cell", cell_of(F.xxhash64(key), bits)).mapInArrow(run, kinds)

    return part(True), part(False)


def maybe_in(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """The first of divided(): rows whose key may be among those of keys."""
    return divided(df, key, keys, n)[0]
