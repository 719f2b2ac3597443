"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import components, freeze, packed, text_bytes, unpacked, with_document_key

SHINGLE = 3
DISTANCE = 3
SEED = 42
# Distinct fingerprints compared within one block; fuller blocks are split further.
BLOCK_LIMIT = 512


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of lower-cased word shingles; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], ">u8"
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, keep: Sequence[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, from the whole text (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            values = [fingerprint(t.as_py(), shingle) for t in texts]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(values, pa.int64())], [*batch.schema.names[:-1], "fp"]
            )

    narrow = docs.select(*keep, text_bytes().alias("_text"))
    schema = narrow.drop("_text").withColumn("fp", F.lit(0).cast("bigint")).schema
    return narrow.mapInArrow(run, schema)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks that keep all but ``distance`` of ``blocks`` even blocks of 64 bits.

    Two fingerprints within ``distance`` bits differ in at most ``distance``
    blocks, so at least one mask leaves them equal.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    full = (1 << 64) - 1
    masks = [full & ~sum(parts[i] for i in out) for out in combinations(range(blocks), distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _stars(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            column = batch.column(0)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                fps = flat[a:b].view(np.uint64)
                near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
                root = np.arange(len(fps))
                while True:  # smallest index each can reach, doubling the reach
                    reach = np.where(near, root[None, :], len(fps)).min(axis=1)
                    reach = np.minimum(reach, reach[reach])
                    if (reach == root).all():
                        break
                    root = reach
                far = np.flatnonzero(root != np.arange(len(fps)))
                left.append(fps[far].view(np.int64))
                right.append(fps[root[far]].view(np.int64))
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"]
                )

    return run


def links(fps: DataFrame, distance: int = DISTANCE, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints ``fp`` linked within ``distance`` bits.

    Fingerprints (distinct) meet on equal blocks. A block with more than
    ``limit`` of them is not compared: its members are cut anew into more and
    smaller blocks, which leaves fewer free bits, until every block is small;
    with 7 * distance + 1 blocks a block cannot hold more than 512 fingerprints
    (distance 3). Within a block the links are verified bit by bit and a star
    per linked set is returned, not every pair.
    """
    found = None
    levels = [distance + 3, 4 * distance, 7 * distance + 1]
    for level, blocks in enumerate(levels):
        last = level == len(levels) - 1
        masks = F.array(*[F.lit(m) for m in block_masks(blocks, distance)])
        cells = fps.select("fp", F.posexplode(masks).alias("t", "m")).select(
            "fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("cell")
        )
        sizes = cells.groupBy("t", "cell").count().where("count > 1")
        if not last:
            sizes = freeze(sizes)
        small = sizes if last else sizes.where(F.col("count") <= limit)
        groups = (
            cells.join(small.drop("count"), ["t", "cell"])
            .groupBy("t", "cell")
            .agg(F.collect_list("fp").alias("fps"))
            .select("fps")
        )
        stars = groups.mapInArrow(_stars(distance), "a bigint, b bigint")
        found = stars if found is None else found.union(stars)
        if last:
            break
        full = sizes.where(F.col("count") > limit)
        if full.limit(1).count() == 0:
            break
        fps = freeze(cells.join(full.drop("count"), ["t", "cell"]).select("fp").distinct())
    return found.distinct()


def near_duplicate_components(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    limit: int = BLOCK_LIMIT,
) -> DataFrame:
    """``keep``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reached over links of at most
    ``distance`` differing bits. A null text has no words: fingerprint zero,
    linked like any other. Rows with a null id take part; the id of a component
    without any id is null. Repeated rows each get their row; texts are hashed
    whole, one at a time, however long. An empty table gives no rows. Columns
    other than ``keep`` are not read.
    """
    keep = list(dict.fromkeys([*keep, "doc_id"]))
    marked = freeze(with_fingerprints(docs, keep, shingle))
    fps = freeze(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(fps.select("fp"), distance, limit))
    placed = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = placed.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(of_fp, "fp")


def keep_one_per_component(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, limit: int = BLOCK_LIMIT
) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (a null id comes last).

    Rows equal in id and text are thinned to one; only rows known to have an
    equal one are compared for it. Whole texts are shuffled once and not sorted.
    """
    keyed = with_document_key(packed(docs, "doc_id", "text"))
    placed = near_duplicate_components(keyed, ["doc_id", "_k1", "_k2"], shingle, distance, limit)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    winners = freeze(placed.groupBy("root").agg(F.min(order).alias("w")).select("w._k1", "w._k2"))
    repeated = freeze(placed.groupBy("_k1", "_k2").count().where("count > 1").select("_k1", "_k2"))
    keys = ["_k1", "_k2"]
    kept = keyed.join(winners.hint("shuffle_hash"), keys, "left_semi")
    if repeated.limit(1).count():
        again = kept.join(repeated.hint("shuffle_hash"), keys, "left_semi").dropDuplicates(keys)
        kept = kept.join(repeated.hint("shuffle_hash"), keys, "left_anti").unionByName(again)
    return kept.select(*unpacked(docs.columns, ("doc_id", "text")))
