"""Column expressions and Spark steps several operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.plans.ordering import freeze
from duskwatch.session import new_folder


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def with_document_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_k1, _k2``: a 128-bit key of (id, text), never null.

    Rows equal in id and text are one document given several times, so no
    operator depends on the order in which rows are read.
    """
    return docs.withColumns(
        {
            "_k1": F.xxhash64(F.lit(7), F.col(id_col).cast("string"), F.lit("|"), F.col(text_col)),
            "_k2": F.xxhash64(F.lit(11), F.col(id_col).cast("string"), F.lit("|"), F.col(text_col)),
        }
    )


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator reads, and all others as one column ``_rest`` that clashes with nothing."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    held = F.struct(*rest) if rest else F.lit(None).cast("int")
    return docs.select(*[c for c in docs.columns if c in needed], held.alias("_rest"))


def unpacked(columns: Sequence[str], needed: Sequence[str], added: Sequence[str] = ()) -> list[Column]:
    """Select list for the columns of the input of ``packed`` and the ``added`` ones.

    An input column with the name of an added one is replaced.
    """
    own = [
        F.col(c) if c in needed else F.col(f"_rest.`{c}`").alias(c) for c in columns if c not in added
    ]
    return [*own, *map(F.col, added)]


def with_zipped_text(keyed: DataFrame) -> DataFrame:
    """``text`` as ``_zip`` (compressed bytes) and ``_null``, for shuffles that carry whole texts."""
    @F.pandas_udf("binary")
    def zipped(texts: pd.Series) -> pd.Series:
        import zstandard

        return texts.map(zstandard.ZstdCompressor(level=1).compress)

    return keyed.withColumns({"_zip": zipped(text_bytes()), "_null": F.col("text").isNull()}).drop("text")


def unzip():
    """The function that undoes ``with_zipped_text`` for one value, inside a task."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def small_batches(spark: SparkSession, rows: int = 2048, size: int = 8 << 20) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows and about ``size`` bytes.

    Batches wait in memory on both sides of a Python worker, whole texts in them;
    a job that runs many stages on the same executors keeps the sum of it low so.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def handing_back(run: Callable) -> Callable:
    """``run`` over Arrow batches, then freed memory goes back to the system.

    Python workers outlive their task and are used again by later stages; without
    this each keeps the most it ever held.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return wrapped


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, root), root the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges stop changing. Every step is a grouped minimum and an equi-join, so a
    node with very many edges is pre-aggregated and its join partition is split
    by adaptive execution. Rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = freeze(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
