"""Integer vectors packed into blocks of bytes, and sums over such blocks without rounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries of one block: 4 MB as 64-bit integers.
BLOCK_VALUES = 1 << 19
# Rows a partition should hold before more partitions pay off.
PARTITION_ROWS = 8192
BLOCK = "ids array<bigint>, dim int, x binary"


def usable(vec: str) -> Column:
    """True where a vector is there and holds neither nulls nor entries that are not finite."""
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(F.col(vec).cast("array<double>"), entry), F.lit(False))


def floored(vec: str, scale: int) -> Column:
    """``floor(scale * entry)`` of every entry, in double arithmetic, as long integers (beyond 64 bits: the nearest)."""
    return F.transform(F.col(vec).cast("array<double>"), lambda v: F.floor(v * float(scale)))


def largest(x: np.ndarray) -> int:
    """The largest absolute entry, as a Python integer."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of ``a`` and ``b``, exact.

    Doubles hold integers below 2^53, so most products run as one matrix product
    of doubles; larger ones use 64-bit integers or Python's. Products beyond
    64 bits become the nearest 64-bit integer.
    """
    bound = a.shape[1] * largest(a) * largest(b)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if largest(x) * max(len(x), 1) < 1 << 63:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def matrix(data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(rows, dim)


def pack(rows: DataFrame, ident: str, x: str) -> DataFrame:
    """Blocks ``ids, dim, x`` of vectors of one length; ``x`` holds the entries row by row.

    Small tables are put into fewer partitions without a shuffle, so that a block
    is worth a task; a large table keeps the partitions it was read in.
    """
    spark = rows.sparkSession
    narrow = rows.select(F.col(ident).cast("bigint").alias("_id"), F.col(x).alias("_x"))
    wanted = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PARTITION_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                step = max(1, BLOCK_VALUES // max(dim, 1))
                for start in range(0, len(at), step):
                    pick = pa.array(at[start : start + step])
                    entries = column.take(pick).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids.take(pick).to_pylist()], pa.list_(pa.int64())),
                            pa.array([dim], pa.int32()),
                            pa.array([entries.tobytes()], pa.binary()),
                        ],
                        ["ids", "dim", "x"],
                    )

    return narrow.coalesce(wanted).mapInArrow(run, BLOCK)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """Inside a task: ids and entries of every packed block."""
    for batch in batches:
        for row in batch.select(["ids", "dim", "x"]).to_pylist():
            yield row["ids"], matrix(row["x"], row["dim"], len(row["ids"]))


def summed(blocks: DataFrame, measure: Callable[[np.ndarray], np.ndarray], size: int, exact: bool = False) -> list:
    """Sum over all blocks of ``measure(entries)``, a list of ``size`` numbers.

    Every task adds up its own blocks and the partial sums are added by Spark, so
    the driver receives ``size`` numbers however many tasks there are.
    """
    kind = "decimal(38,0)" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total = None
        for _, x in blocks_of(batches):
            part = measure(x)
            total = part if total is None else [a + b for a, b in zip(total, part)] if exact else total + part
        if total is not None:
            values = (
                pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
                if exact
                else pa.array(np.asarray(total, np.float64))
            )
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), values], ["at", "v"])

    found = blocks.mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = [0] * size
    for row in found:
        out[row["at"]] = int(row["v"]) if exact else row["v"]
    return out
