"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import freeze
from duskwatch.llm.integer_vectors import blocks_of, floored, pack, products, usable
from duskwatch.session import new_folder

SCALE = 1024
BINS = 128
# Entries of the queries that are broadcast at a time; more are searched group by group.
QUERY_VALUES = 1 << 22
# Scores a task holds at a time.
SCORE_VALUES = 1 << 21
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


class _Search:
    """Per query of a group: the range its kth key lies in, and how many keys of that range are taken.

    Keys are scores first. Queries whose kth score is known but shared by more
    candidates than are still needed go on with ids as keys, smallest first.
    ``low`` and ``high`` hold Python integers.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, reach: int, k: int):
        self.ids, self.x = ids, x
        count = len(ids)
        norms = [math.isqrt(int(v)) + 1 for v in (x.astype(object) ** 2).sum(axis=1)] if count else []
        self.high = [min(n * reach, (1 << 63) - 1) for n in norms]
        self.low = [-h for h in self.high]
        self.need = [k] * count
        self.score: list[int | None] = [None] * count  # the kth score, where ids decide
        self.done = [False] * count

    def active(self) -> np.ndarray:
        return np.flatnonzero(~np.array(self.done, bool))

    def width(self, i: int, bins: int) -> int:
        return -(-(self.high[i] - self.low[i] + 1) // bins)

    def narrow(self, i: int, bin_: int, above: int, inside: int, bins: int, first_id: int, last_id: int) -> None:
        width = self.width(i, bins)
        low = self.low[i] + bin_ * width
        self.low[i], self.high[i] = low, min(self.high[i], low + width - 1)
        self.need[i] -= above
        if inside <= self.need[i]:
            self.done[i] = True
        elif self.low[i] == self.high[i]:
            if self.score[i] is not None:
                self.done[i] = True  # rows of one id and score: any of them
            else:
                self.score[i] = low
                self.low[i], self.high[i] = ~last_id, ~first_id


def _scores(search: _Search, chosen: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
    """Pieces ``(queries, scores, own)`` of the chosen queries against one block."""
    step = max(1, SCORE_VALUES // max(len(x), 1))
    for start in range(0, len(chosen), step):
        part = chosen[start : start + step]
        own = known[None, :] & (ids[None, :] == search.ids[part][:, None])
        yield part, products(search.x[part], x), own


def _counts(search: _Search, k: int, bins: int, last_id: int):
    """A task's histogram of every open query, without the bins that cannot hold the kth key."""
    chosen = search.active()
    by_id = np.array([search.score[i] is not None for i in chosen], bool)
    low = np.array([search.low[i] for i in chosen], np.int64)
    high = np.array([search.high[i] for i in chosen], np.int64)
    width = np.array([search.width(i, bins) for i in chosen], np.uint64)
    fixed = np.array([search.score[i] or 0 for i in chosen], np.int64)
    need = np.array([search.need[i] for i in chosen])
    row_of = np.full(len(search.ids), -1)
    row_of[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(chosen) * bins, np.int64)
        for raw, x in blocks_of(batches):
            if x.shape[1] != search.x.shape[1]:
                continue
            known = np.array([i is not None for i in raw], bool)
            ids = np.array([last_id if i is None else i for i in raw], np.int64)
            for part, scores, own in _scores(search, chosen, ids, known, x):
                rows = row_of[part]
                least = low[rows]
                if len(x) > k + 1:  # keys below the k + 1st of the block: from its bin's edge on (one may be the query's own)
                    edge = np.partition(scores, len(x) - k - 1, axis=1)[:, len(x) - k - 1]
                    down = (np.maximum(edge, least) - least).astype(np.uint64) % width[rows]
                    least = np.where(by_id[rows], least, np.maximum(edge, least) - down.astype(np.int64))
                keys = scores
                if by_id.any():
                    keys = np.where(by_id[rows][:, None], ~ids[None, :], scores)
                takes = (keys >= least[:, None]) & (keys <= high[rows][:, None]) & ~own
                if by_id.any():
                    takes &= ~by_id[rows][:, None] | (scores == fixed[rows][:, None])
                r, c = np.nonzero(takes)
                offset = keys[r, c].astype(np.uint64) - low[rows[r]].astype(np.uint64)
                at = rows[r] * bins + (offset // width[rows[r]]).astype(np.int64)
                counts += np.bincount(at, minlength=len(counts))
        table = counts.reshape(-1, bins)
        above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
        q, b = np.nonzero((table > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(chosen[q].astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(table[q, b])],
            ["q", "bin", "n"],
        )

    return run


def _taken(search: _Search, k: int, last_id: int):
    """A task's candidates at or above the bounds found; at most ``k`` a query, as ties of one id may remain."""
    everyone = np.arange(len(search.ids))
    by_id = np.array([s is not None for s in search.score], bool)
    floor = np.array([low if s is None else s for low, s in zip(search.low, search.score)], np.int64)
    id_floor = np.array([low if s is not None else 0 for low, s in zip(search.low, search.score)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros((0, 4), np.int64)]
        for raw, x in blocks_of(batches):
            if x.shape[1] != search.x.shape[1]:
                continue
            known = np.array([i is not None for i in raw], bool)
            ids = np.array([last_id if i is None else i for i in raw], np.int64)
            for part, scores, own in _scores(search, everyone, ids, known, x):
                bound = floor[part][:, None]
                tied = (scores == bound) & (~by_id[part][:, None] | (~ids[None, :] >= id_floor[part][:, None]))
                r, c = np.nonzero(((scores > bound) | tied) & ~own)
                kept.append(np.column_stack([part[r], scores[r, c], ids[c], known[c]]))
            rows = np.concatenate(kept)
            rows = rows[np.lexsort((1 - rows[:, 3], rows[:, 2], ~rows[:, 1], rows[:, 0]))]
            place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
            kept = [rows[place < k]]
        rows = kept[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[:, 0].astype(np.int32)),
                pa.array(search.ids[rows[:, 0]]),
                pa.array(rows[:, 2], mask=rows[:, 3] == 0),
                pa.array(rows[:, 1]),
            ],
            ["q", "query_id", "vec_id", "score"],
        )

    return run


def _search_group(blocks: DataFrame, ids: np.ndarray, x: np.ndarray, reach: int, k: int, span: tuple[int, int], bins: int) -> DataFrame:
    search = _Search(ids, x, reach, k)
    first_id, last_id = span
    while len(search.active()):
        found = blocks.mapInArrow(_counts(search, k, bins, last_id), "q int, bin int, n bigint")
        needs = blocks.sparkSession.createDataFrame(
            [(int(i), search.need[i]) for i in search.active()], "q int, need bigint"
        )
        down = Window.partitionBy("q").orderBy(F.col("bin").desc())
        reached = (
            found.groupBy("q", "bin")
            .agg(F.sum("n").alias("n"))
            .withColumn("upto", F.sum("n").over(down))
            .join(F.broadcast(needs), "q")  # one row per query of the group
            .where("upto - n < need")  # bins down to the one that holds the kth key
            .groupBy("q")
            .agg(F.min("bin").alias("bin"), F.max("upto").alias("upto"), F.min_by("n", "bin").alias("n"))
        )
        seen = {r["q"]: r for r in reached.collect()}
        for i in search.active().tolist():
            if i not in seen:
                search.done[i] = True  # no candidate at all
                continue
            r = seen[i]
            search.narrow(i, r["bin"], r["upto"] - r["n"], r["n"], bins, first_id, last_id)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    rows = blocks.mapInArrow(_taken(search, k, last_id), "q int, query_id bigint, vec_id bigint, score bigint")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    ident: str = "vec_id",
    vec: str = "embedding",
    scale: int = SCALE,
    bins: int = BINS,
    group_values: int = QUERY_VALUES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each query.

    Entries become ``floor(scale * entry)``. Every query is scored against every
    candidate, block by block; no score is stored. Rounds of histograms over the
    range that holds a query's kth score narrow it down to one value; where more
    candidates share that score than are needed, the same rounds over ids find the
    last id taken. A last visit filters by both bounds.

    Vectors that are null or hold nulls or entries that are not finite take no
    part; a vector meets only vectors of its own length. All rows with the id of a
    query are left out of its candidates. Ties go to smaller ids, a null id comes
    last and a query without id is left out. Repeated candidates each count;
    repeated queries (same id and vector) are answered once, queries of one id and
    different vectors each. Fewer candidates than ``k`` are all returned; empty
    tables give no rows. Other columns are not read.

    Queries are broadcast in groups of at most ``group_values`` entries, each
    group searched on its own.
    """
    spark = queries.sparkSession
    x = floored(vec, scale).alias("x")
    usual = candidates.where(usable(vec)).select(F.col(ident).cast("bigint").alias("id"), x)
    blocks = freeze(pack(usual, "id", "x"))
    square = F.aggregate(
        F.transform("x", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, b: a + b
    )
    low, high, most = usual.agg(F.min("id"), F.max("id"), F.max(square)).first()
    reach = math.isqrt(math.ceil((most or 0.0) * (1 + 1e-9))) + 1
    # a null id stands behind all others
    low, high = low or 0, min((high or 0) + 1, (1 << 63) - 1)
    asked = (
        queries.where(usable(vec)).where(F.col(ident).isNotNull())
        .select(F.col(ident).cast("bigint").alias("id"), x).distinct()
    )
    path = new_folder(spark, "top-k")
    spark.createDataFrame([], RESULT).write.parquet(path)
    sized = freeze(asked.withColumn("dim", F.size("x")))
    for dim, count in sorted(map(tuple, sized.groupBy("dim").count().collect())):
        groups = -(-count * max(dim, 1) // group_values)
        dealt = sized.where(F.col("dim") == dim).withColumn("g", F.pmod(F.xxhash64("id", "x"), F.lit(groups)))
        for g in range(groups):
            rows = dealt.where(F.col("g") == g).select("id", "x").toPandas().sort_values("id", kind="stable")
            if len(rows):
                entries = np.array(rows["x"].tolist(), np.int64).reshape(len(rows), dim)
                found = _search_group(blocks, rows["id"].to_numpy(np.int64), entries, reach, k, (low, high), bins)
                found.write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
